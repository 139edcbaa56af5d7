"""Delivery decisions and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.functions import status as st
from labtables.operators import delivery as D
from labtables.plans.bindings._registry import (
    SAMPLE_QC_SQL,
    order_projects,
    order_samples,
    query,
    table,
)
from labtables.plans.delivery_round import Round, delivery_round

# Reports of an order: finished ones have a first, unsigned report and every
# third a second one; every fifth open one has a single signed report.
REPORTS_SQL = """
    rep AS (
      SELECT o_orderkey AS k, 1 AS seq, '' AS signee, false AS rejected FROM orders WHERE o_orderstatus = 'F'
      UNION ALL
      SELECT o_orderkey, 2, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END,
             o_orderpriority = '1-URGENT' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0
      UNION ALL
      SELECT o_orderkey, 1, o_orderpriority, false FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 5 = 0),
    last AS (SELECT k, arg_max(signee, seq) AS signee, arg_max(rejected, seq) AS rejected FROM rep GROUP BY k)
"""

DECISION_SQL = f"""
    q AS (SELECT l_orderkey AS k, {SAMPLE_QC_SQL} AS qc FROM lineitem),
    f AS (SELECT k, bool_or(qc = 'Pending') AS pend, bool_or(qc = 'Passed') AS pass,
            bool_and(qc IN ('Passed', 'Aborted')) AS pa, bool_and(qc = 'Aborted') AS ab FROM q GROUP BY k),
    {REPORTS_SQL},
    d AS (SELECT o_orderkey AS project_id, CASE
        WHEN coalesce(pend, false) THEN 'none'
        WHEN last.k IS NOT NULL AND signee <> '' AND NOT rejected THEN 'proceed_delivery'
        WHEN last.k IS NOT NULL THEN 'wait_for_signing'
        WHEN o_orderkey % 2 = 0 AND coalesce(pass, false) THEN 'generate_report'
        WHEN o_orderkey % 2 = 0 THEN 'finish_no_passed_samples'
        WHEN coalesce(pa, true) AND coalesce(pass, false) THEN 'generate_report'
        WHEN coalesce(ab, true) THEN 'finish_all_samples_aborted'
        ELSE 'finish_some_samples_failed' END AS action
      FROM orders LEFT JOIN f ON o_orderkey = f.k LEFT JOIN last ON o_orderkey = last.k)
"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = F.col("o_orderstatus") == "F"
    entry = F.struct
    first = F.when(finished, entry(F.lit(1).alias("seq"), F.lit("").alias("signee"), F.lit(False).alias("rejected")))
    second = F.when(
        finished & (F.col("o_orderkey") % 3 == 0),
        entry(
            F.lit(2).alias("seq"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.col("o_orderpriority")).alias("signee"),
            (F.col("o_orderpriority") == "1-URGENT").alias("rejected"),
        ),
    )
    signed = F.when(
        (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0),
        entry(F.lit(1).alias("seq"), F.col("o_orderpriority").alias("signee"), F.lit(False).alias("rejected")),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("project_id"),
        F.inline(F.array_compact(F.array(first, second, signed))),
    )


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_projects(
        spark,
        sf_dir,
        (F.col("o_orderkey") % 2 == 0).alias("partial_delivery_allowed"),
        F.lit(None).cast("string").alias("dds_project_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("name "), F.col("o_orderkey").cast("string"))).alias(
            "project_name"
        ),
    )


@query(f"WITH {DECISION_SQL} SELECT * FROM d")
def delivery_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = D.delivery_decisions(
        _projects(spark, sf_dir), order_samples(spark, sf_dir), _reports(spark, sf_dir), "project_id"
    )
    return decided.select("project_id", "action")


@query(
    f"""
    SELECT l_orderkey AS project_id, bool_or(qc = 'Pending') AS any_pending, bool_or(qc = 'Passed') AS any_passed,
      bool_and(qc IN ('Passed', 'Aborted')) AS all_passed_or_aborted, bool_and(qc = 'Aborted') AS all_aborted,
      count(*) AS n_samples
    FROM (SELECT l_orderkey, {SAMPLE_QC_SQL} AS qc FROM lineitem) GROUP BY l_orderkey
    """
)
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labtables.operators.lifecycle import summarise_samples

    return summarise_samples(order_samples(spark, sf_dir), "project_id", qc="qc")


@query(
    """
    SELECT o_custkey AS project_id, arg_max(o_orderpriority, o_orderkey) AS signee,
      arg_max(o_orderstatus = 'P', o_orderkey) AS rejected FROM orders GROUP BY o_custkey
    """
)
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("signee"),
        (F.col("o_orderstatus") == "P").alias("rejected"),
    )
    return D.latest_report(reports, "project_id", "seq", ["signee", "rejected"])


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples of their source: quality label = QC, toxic = delivered."""
    qc = F.when(F.col("quality") == 1, "Passed").when(F.col("quality") == 0, "Failed").otherwise("Pending")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("source").alias("project_id"),
        F.col("doc_id").alias("sample_id"),
        qc.alias("qc"),
        (F.col("toxic") == 1).alias("delivered"),
    )


REVIEWED_SQL = """
    s AS (SELECT source AS project_id, d.doc_id AS sample_id,
      CASE quality WHEN 1 THEN 'Passed' WHEN 0 THEN 'Failed' ELSE 'Pending' END AS qc,
      coalesce(toxic = 1, false) AS delivered
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


@query(f"WITH {REVIEWED_SQL} SELECT project_id, sample_id FROM s WHERE qc = 'Passed' AND NOT delivered")
def samples_to_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _reviewed(spark, sf_dir)
    return samples.where(st.to_deliver("qc", "delivered")).select("project_id", "sample_id")


@query(f"WITH {REVIEWED_SQL} SELECT project_id, sample_id, qc, delivered OR qc = 'Passed' AS delivered FROM s")
def mark_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mark_delivered(_reviewed(spark, sf_dir))


@query(
    f"""
    WITH {REVIEWED_SQL}
    SELECT n_name AS project_id, 'DDS123' AS dds_project_id, 0 AS n_included, 'unknown' AS total_volume,
      'delivered' AS delivery_status FROM nation
    UNION ALL
    SELECT project_id, 'DDS123', count(*) FILTER (qc = 'Passed' AND NOT delivered), 'unknown', 'delivered'
    FROM s GROUP BY project_id
    """
)
def delivery_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, and nations as projects that have no samples at all."""
    samples = _reviewed(spark, sf_dir)
    none = F.lit(None).cast("string").alias("dds_project_id")
    projects = samples.select("project_id", none).distinct().unionByName(
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("project_id"), none)
    )
    return D.delivery_entries(projects, samples, "project_id")


@query(
    f"""
    WITH {DECISION_SQL}
    SELECT project_id, count(*) FILTER (qc = 'Passed') AS n_included, '2025-01-01 12:00:00' AS date_uploaded,
      '2025-01-01 12:00:00' AS date_released
    FROM d LEFT JOIN q ON k = project_id WHERE action = 'proceed_delivery' GROUP BY project_id
    """
)
def delivery_round_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _round(spark, sf_dir).entries
    return entries.select("project_id", "n_included", "date_uploaded", "date_released")


def _round(spark: SparkSession, sf_dir: str) -> Round:
    samples = order_samples(
        spark, sf_dir, "l_linenumber", "l_partkey", F.lit(False).alias("delivered")
    )
    now = F.lit("2025-01-01 12:00:00")
    return delivery_round(
        _projects(spark, sf_dir), samples, _reports(spark, sf_dir), "project_id", "l_linenumber", now, "project_name"
    )


@query(
    f"""
    WITH {DECISION_SQL}
    SELECT l_orderkey AS project_id, l_linenumber FROM (SELECT *, {SAMPLE_QC_SQL} AS qc FROM lineitem)
    JOIN d ON l_orderkey = d.project_id WHERE qc = 'Passed' AND action = 'proceed_delivery'
    """
)
def delivery_round_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of this round's entries."""
    return _round(spark, sf_dir).included


@query(
    f"""
    WITH {DECISION_SQL}
    SELECT project_id, count(*) AS n_included, CASE WHEN project_id % 3 <> 0 THEN 'name ' ELSE '' END || CAST(project_id AS VARCHAR) || '_project_summary.html' AS file_name,
      '2025-01-01 12:00:00' AS date_created, '' AS signee, '' AS date_signed, false AS rejected
    FROM d JOIN q ON k = project_id WHERE action = 'generate_report' AND qc = 'Passed' GROUP BY project_id
    """
)
def delivery_round_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New unsigned reports of the projects that need one."""
    return _round(spark, sf_dir).reports


@query(
    f"""
    WITH {DECISION_SQL}
    SELECT l_orderkey AS project_id, l_linenumber, l_partkey, qc,
      qc = 'Passed' AND action = 'proceed_delivery' AS delivered
    FROM (SELECT *, {SAMPLE_QC_SQL} AS qc FROM lineitem) JOIN d ON l_orderkey = d.project_id
    """
)
def delivery_round_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spark, sf_dir).samples.drop("status")


@query(
    """
    SELECT l_orderkey AS project_id, 'FC' || CAST(l_suppkey AS VARCHAR) AS flowcell
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'
    UNION
    SELECT l_orderkey, 'FC' || CAST(l_partkey % 100 AS VARCHAR)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'
    """
)
def project_flowcells(spark: SparkSession, sf_dir: str) -> DataFrame:
    flowcells = F.array(
        F.concat(F.lit("FC"), F.col("l_suppkey").cast("string")),
        F.concat(F.lit("FC"), (F.col("l_partkey") % 100).cast("string")),
    )
    samples = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), flowcells.alias("flowcells")
    )
    projects = order_projects(
        spark, sf_dir, (F.col("o_orderstatus") != "O").alias("deliver_flowcell")
    )
    return D.project_flowcells(projects, samples, "project_id", "flowcells")
