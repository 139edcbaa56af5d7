"""Predicates, roll-ups and status history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.functions import status as st
from labtables.functions import text
from labtables.functions._cols import case_lookup
from labtables.operators import lifecycle as L
from labtables.plans.bindings._registry import (
    FLAGS_SQL,
    ROLLUP_SQL,
    SAMPLE_STATUS_SQL,
    STAMP_SQL,
    order_projects,
    order_samples,
    query,
    stamp,
    table,
)


@query(
    f"""
    WITH f AS ({FLAGS_SQL})
    SELECT o_orderkey AS project_id, {ROLLUP_SQL.format(finished='completed')} AS project_status,
           {ROLLUP_SQL.format(finished='processing')} AS project_status_as_is
    FROM orders LEFT JOIN f ON o_orderkey = k
    """
)
def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.project_rollup(
        order_projects(spark, sf_dir),
        order_samples(spark, sf_dir),
        "project_id",
        outputs={"project_status": "completed", "project_status_as_is": "processing"},
    )


@query(
    """
    WITH s AS (SELECT l_orderkey AS project_id,
        CASE WHEN l_linenumber = 7 THEN 'processed'
             WHEN l_linenumber = 6 THEN 'post_processing_failed'
             WHEN l_returnflag = 'A' THEN 'completed' ELSE 'pending' END AS st FROM lineitem)
    SELECT project_id, count(*) FILTER (st = 'processed') AS n_processed,
           count(*) FILTER (st = 'post_processing_failed') AS n_failed,
           count(*) FILTER (st = 'completed') AS n_done,
           count(*) FILTER (st = 'pending') AS n_leftover
    FROM s GROUP BY project_id
    """
)
def sample_counts_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    status = (
        F.when(number == 7, "processed")
        .when(number == 6, "post_processing_failed")
        .when(F.col("l_returnflag") == "A", "completed")
        .otherwise("pending")
    )
    samples = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), status.alias("status")
    )
    bucket = st.post_process_bucket("status")
    return L.counts_by_bucket(
        samples, "project_id", bucket, ["processed", "failed", "done", "leftover"]
    )


@query(
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, {SAMPLE_STATUS_SQL} AS status
    FROM lineitem
    WHERE {SAMPLE_STATUS_SQL} NOT IN ('aborted', 'unsequenced', 'completed')
      AND NOT (l_linenumber = 2 AND l_returnflag = 'R')
      AND l_quantity < 45
    """
)
def select_processable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = F.when(
        (F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "R"), F.lit("Aborted")
    ).when(F.col("l_linenumber") == 3, F.lit("ok"))
    barcode = F.when(F.col("l_quantity") >= 45, F.lit("bad")).otherwise(F.lit("good"))
    samples = order_samples(
        spark, sf_dir, "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"
    )
    return (
        samples.where(st.processable("status"))
        .where(st.not_aborted(manual))
        .where(st.good_barcode(barcode))
        .select("l_orderkey", "l_linenumber", "l_partkey", "status")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'manually_submitted'
             WHEN 'RF' THEN 'auto-submitted' ELSE 'processing' END AS status
    FROM lineitem
    WHERE l_returnflag || l_linestatus IN ('AF', 'RF', 'RO') AND l_linenumber > 1
    """
)
def jobs_to_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = case_lookup(
        F.concat("l_returnflag", "l_linestatus"),
        {"AF": "manually_submitted", "RF": "auto-submitted", "RO": "processing"},
        F.lit("pending"),
    )
    job_id = F.when(F.col("l_linenumber") > 1, F.col("l_partkey").cast("string")).otherwise("")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("status", status)
        .where(st.to_monitor(job_id, "status"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "status")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'processed'
             WHEN 'RF' THEN 'failed' WHEN 'AO' THEN 'done' ELSE 'leftover' END AS bucket
    FROM lineitem
    """
)
def post_process_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = case_lookup(
        F.concat("l_returnflag", "l_linestatus"),
        {"AF": "processed", "RF": "post_processing_failed", "AO": "completed"},
        F.lit("processing"),
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", st.post_process_bucket(status).alias("bucket")
    )


@query(
    f"""
    WITH f AS ({FLAGS_SQL}), p AS (
      SELECT o_orderkey AS project_id,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'manually_submitted_samples'
             WHEN o_orderkey % 7 = 0 THEN NULL
             ELSE {ROLLUP_SQL.format(finished='completed')} END AS st
      FROM orders LEFT JOIN f ON o_orderkey = k)
    SELECT project_id, CASE WHEN coalesce(st, '') IN ('', 'pending', 'partially_completed') THEN 'main'
        WHEN st = 'manually_submitted_samples' THEN 'monitor'
        WHEN st = 'completed' THEN 'none' ELSE 'skip' END AS flow
    FROM p
    """
)
def project_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = L.project_rollup(
        order_projects(spark, sf_dir, "o_orderstatus"), order_samples(spark, sf_dir), "project_id"
    )
    manual = (F.col("o_orderstatus") == "P") & (F.col("project_id") % 4 == 0)
    status = F.when(manual, F.lit("manually_submitted_samples")).when(
        F.col("project_id") % 7 != 0, F.col("project_status")
    )
    return rolled.select("project_id", st.project_flow(status).alias("flow"))


@query(
    """
    SELECT event_id,
      CASE WHEN event_id % 10 <> 0 THEN CAST(event_id AS VARCHAR) END AS job_id,
      CASE event_type WHEN 'view' THEN 'processed' WHEN 'signup' THEN NULL
        ELSE 'processing_failed' END AS status
    FROM events
    """
)
def job_state_to_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = case_lookup(
        "event_type",
        {
            "view": "COMPLETED",
            "click": "FAILED",
            "error": "CANCELLED+",
            "purchase": "OUT_OF_ME+",
            "signup": "RUNNING",
        },
    )
    printed = F.when(
        F.col("event_id") % 10 == 0, F.lit("error: no job was made")
    ).otherwise(F.concat(F.lit("Submitted batch job "), F.col("event_id").cast("string"), F.lit(" ok")))
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.job_id_from_text(printed).alias("job_id"),
        st.job_status(state).alias("status"),
    )


@query(
    """
    SELECT d.doc_id, NOT coalesce(toxic = 1, false) AND coalesce(CASE WHEN lang <> 'de' THEN n_chars > 100 END, true)
        AND coalesce(quality = 1, false) AS auto_submit
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def auto_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as projects; flags are null where the label or language says nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    decision = st.auto_submit(
        F.col("toxic") == 1,
        F.when(F.col("lang") != "de", F.col("n_chars") > 100),
        F.col("quality") == 1,
    )
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", decision.alias("auto_submit")
    )


@query(
    """
    SELECT source, bool_and(coalesce(quality = 1, false) OR n_chars < 5000) AS realm_auto
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source
    """
)
def realm_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as projects: may all their documents be submitted?"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    samples = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn(
        "auto", F.coalesce(F.col("quality") == 1, F.lit(False)) | (F.col("n_chars") < 5000)
    )
    return L.realm_supports_auto(samples, "source", "auto")


# event type -> sample status, for the queries that read events as a status log
EVENT_STATUS = {
    "click": "processing",
    "view": "running",
    "purchase": "completed",
    "error": "processing_failed",
    "signup": "pending",
}

EVENT_STATUS_SQL = """CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'running'
    WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'processing_failed' ELSE 'pending' END"""


@query(
    f"""
    SELECT user_id, arg_max({EVENT_STATUS_SQL}, event_id) AS status,
      max({STAMP_SQL.format('ts')}) FILTER (event_type IN ('click', 'view')) AS start_time,
      max({STAMP_SQL.format('ts')}) FILTER (event_type IN ('purchase', 'error')) AS end_time
    FROM events GROUP BY user_id
    """
)
def current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn(
        "status", case_lookup("event_type", EVENT_STATUS)
    )
    last = L.current_status(log, ["user_id"], "status", "event_id", "ts")
    return last.select(
        "user_id",
        "status",
        stamp("start_time").alias("start_time"),
        stamp("end_time").alias("end_time"),
    )


@query(
    f"""
    WITH c AS (SELECT user_id, max(event_id) FILTER (event_type IN ('error', 'click')) AS cleared
               FROM events GROUP BY user_id),
    f AS (SELECT e.user_id, min(e.event_id) AS first_id FROM events e JOIN c ON e.user_id = c.user_id
          WHERE e.event_type IN ('purchase', 'signup') AND e.event_id > coalesce(c.cleared, -1)
          GROUP BY e.user_id)
    SELECT c.user_id, {STAMP_SQL.format('e.ts')} AS end_date
    FROM c LEFT JOIN f ON c.user_id = f.user_id LEFT JOIN events e ON e.event_id = f.first_id
    """
)
def project_end_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = case_lookup(
        "event_type",
        {
            "purchase": "completed",
            "signup": "partially_completed",
            "error": "failed",
            "click": "processing",
            "view": "pending",
        },
    )
    log = table(spark, sf_dir, "events").withColumn("status", status)
    dates = L.project_end_date(log, "user_id", "status", "event_id", "ts")
    return dates.select("user_id", stamp("end_date").alias("end_date"))
