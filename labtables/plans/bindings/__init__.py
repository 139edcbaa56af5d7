"""The operators applied to the driver's tables, each with its oracle SQL."""

from labtables.plans.bindings import (  # noqa: F401 - imported for registration
    deliveries,
    documents,
    files,
    plates,
    routes,
    runs,
    samples,
    statuses,
    streams,
    upserts,
)
from labtables.plans.bindings._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
