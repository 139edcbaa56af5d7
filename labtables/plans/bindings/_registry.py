"""Registry of driver queries: the Spark job and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a driver query under its own name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# Shared reading of the driver tables: project = order, sample = line item.
# --------------------------------------------------------------------------

# return flag || line status -> sample status
SAMPLE_STATUS = {
    "AF": "completed",
    "AO": "aborted",
    "NF": "pending",
    "NO": "unsequenced",
    "RF": "failed",
    "RO": "processing",
}

SAMPLE_STATUS_SQL = """CASE l_returnflag || l_linestatus
    WHEN 'AF' THEN 'completed' WHEN 'AO' THEN 'aborted' WHEN 'NF' THEN 'pending'
    WHEN 'NO' THEN 'unsequenced' WHEN 'RF' THEN 'failed' ELSE 'processing' END"""

# return flag [|| line status] -> quality
SAMPLE_QC_SQL = """CASE WHEN l_returnflag = 'A' THEN 'Passed' WHEN l_returnflag = 'R' THEN 'Aborted'
    WHEN l_linestatus = 'O' THEN 'Pending' ELSE '' END"""

# The roll-up rule over flags a (any active), b (all finished), c (all not started).
ROLLUP_SQL = """CASE WHEN coalesce(a, false) THEN 'processing'
    WHEN coalesce(b, true) THEN '{finished}' WHEN c THEN 'pending'
    ELSE 'partially_completed' END"""

FLAGS_SQL = """SELECT l_orderkey AS k,
    bool_or(st IN ('initialized', 'processing', 'pre_processing', 'post_processing',
                   'requires_manual_submission')) AS a,
    bool_and(st IN ('completed', 'aborted')) AS b,
    bool_and(st IN ('pending', 'unsequenced')) AS c
  FROM (SELECT l_orderkey, {status} AS st FROM lineitem) GROUP BY l_orderkey""".format(
    status=SAMPLE_STATUS_SQL
)


def sample_status() -> Column:
    from labtables.functions._cols import case_lookup

    return case_lookup(F.concat("l_returnflag", "l_linestatus"), SAMPLE_STATUS)


def sample_qc() -> Column:
    return (
        F.when(F.col("l_returnflag") == "A", F.lit("Passed"))
        .when(F.col("l_returnflag") == "R", F.lit("Aborted"))
        .when(F.col("l_linestatus") == "O", F.lit("Pending"))
        .otherwise(F.lit(""))
    )


def order_samples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Line items as samples, with the extra columns asked for."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        sample_status().alias("status"),
        sample_qc().alias("qc"),
        *columns,
    )


def order_projects(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("project_id"), *columns
    )


def stamp(ts: str | Column) -> Column:
    """Timestamp as text, the same in any engine and time zone."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


STAMP_SQL = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
