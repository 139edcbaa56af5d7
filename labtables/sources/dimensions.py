"""Small configuration tables held in Python, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def dimension(spark: SparkSession, ddl: str, rows: Iterable[tuple]) -> DataFrame:
    """A configuration table with a declared schema.

    Built from Arrow, so Spark knows its exact size: joins to it are broadcast
    when that size is under the session's threshold and shuffled beyond it,
    without a hint.
    """
    schema = T.StructType.fromDDL(ddl)
    names = [f.name for f in schema]
    records = [dict(zip(names, row, strict=True)) for row in rows]
    table = pa.Table.from_pylist(records, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)
