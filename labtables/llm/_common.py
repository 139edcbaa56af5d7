"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads; a null text becomes the empty one.

    Every operator starts from this, so columns of its own cannot clash with extra ones.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def letters_hash(*columns: str | Column) -> Column:
    """64-bit hash that is never null."""
    return F.xxhash64(*columns)


def per_worker(key: str, make: Callable[[], object]) -> object:
    """An object made once per Python worker, which Spark reuses for many tasks.

    Only the objects of one module are kept: workers outlive a stage, and what the operator of
    an earlier stage kept would stay beside that of the present one.
    """
    kept = vars(sys).setdefault("_labtables_per_worker", {})
    if kept.get("owner") != make.__module__:
        kept.clear()
        kept["owner"] = make.__module__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def parts_for(spark: SparkSession, at_least: int = 1) -> int:
    """The session's number of shuffle partitions, which follows the cluster and its data."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Hand freed memory back to the machine, between batches.

    Python workers outlive their stage, and what their allocators keep of it would count
    beside the memory of the next stage's workers.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
