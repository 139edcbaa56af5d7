"""Operators for preparing training data: one module each, with their queries in ``queries``."""

import sys

from pyspark import cloudpickle

# The task functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
