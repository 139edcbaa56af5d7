"""Samples: flowcells, grouping, references, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.functions.text import flowcell_date
from labtables.schemas import RUN_SUCCESS_MARKER
from labtables.operators import samples as S
from labtables.plans.bindings._registry import query, table
from labtables.plans import post_run as R
from labtables.plans.bindings.statuses import EVENT_STATUS, EVENT_STATUS_SQL
from labtables.functions._cols import case_lookup
from labtables.sources.dimensions import dimension

# Flowcell id of an order: long or short date by parity, some without a date.
FLOWCELL_SQL = """CASE WHEN o_orderkey % 50 = 0 THEN 'undated_' || CAST(o_orderkey AS VARCHAR)
    WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d') || '_' || CAST(o_orderkey AS VARCHAR)
    ELSE strftime(o_orderdate, '%y%m%d') || '_' || CAST(o_orderkey AS VARCHAR) END"""


def _flowcell() -> Column:
    key = F.col("o_orderkey").cast("string")
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(
        F.date_format("o_orderdate", "yyMMdd")
    )
    prefix = F.when(F.col("o_orderkey") % 50 == 0, F.lit("undated")).otherwise(form)
    return F.concat_ws("_", prefix, key)


@query(
    f"""
    SELECT o_orderkey, {FLOWCELL_SQL} AS flowcell,
      CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS flowcell_date
    FROM orders
    """
)
def flowcell_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _flowcell().alias("flowcell"))
    return orders.withColumn("flowcell_date", flowcell_date("flowcell").cast("string"))


@query(
    f"""
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, {FLOWCELL_SQL} AS flowcell FROM orders),
    l AS (SELECT o_custkey, arg_max(flowcell, (o_orderdate, -o_orderkey)) AS latest_flowcell
          FROM o WHERE o_orderkey % 50 <> 0 GROUP BY o_custkey)
    SELECT c_custkey, latest_flowcell,
      CASE WHEN latest_flowcell IS NULL THEN 'unsequenced' ELSE 'initialized' END AS status
    FROM customer LEFT JOIN l ON c_custkey = o_custkey
    """
)
def latest_flowcell(spark: SparkSession, sf_dir: str) -> DataFrame:
    flowcells = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", _flowcell().alias("flowcell")
    )
    latest = S.latest_flowcell(flowcells, ["c_custkey"], "flowcell", "o_orderkey")
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey")
        .join(latest, "c_custkey", "left")
        .withColumn("status", S.sequencing_status("latest_flowcell"))
    )


def _preps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples with two preps: A holds the order's own flowcell and an
    undated one, B one of 30 days before."""
    earlier = F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), 30), "yyyyMMdd")
    prep_a = F.struct(
        F.concat(F.lit("bc-"), F.col("o_orderkey").cast("string")).alias("barcode"),
        F.array(F.lit("undated_0"), _flowcell()).alias("sequenced_fc"),
    )
    prep_b = F.struct(
        F.lit("bc-b").alias("barcode"), F.array(F.concat(earlier, F.lit("_b"))).alias("sequenced_fc")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.create_map(F.lit("A"), prep_a, F.lit("B"), prep_b).alias("library_prep")
    )


@query(
    f"""
    SELECT o_orderkey, 'A' AS prep, 'undated_0' AS flowcell, 0 AS prep_pos, 0 AS fc_pos FROM orders
    UNION ALL SELECT o_orderkey, 'A', {FLOWCELL_SQL}, 0, 1 FROM orders
    UNION ALL SELECT o_orderkey, 'B', strftime(o_orderdate - INTERVAL 30 DAY, '%Y%m%d') || '_b', 1, 0 FROM orders
    """
)
def explode_flowcells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.explode_flowcells(_preps(spark, sf_dir), "library_prep", "o_orderkey")
    return rows.select(
        "o_orderkey",
        "prep",
        "flowcell",
        F.col("ordinal._prep_pos").alias("prep_pos"),
        F.col("ordinal._fc_pos").alias("fc_pos"),
    )


@query(
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0
        THEN strftime(o_orderdate - INTERVAL 30 DAY, '%Y%m%d') || '_b' ELSE {FLOWCELL_SQL} END AS latest_flowcell
    FROM orders
    """
)
def latest_flowcell_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preps(spark, sf_dir).select(
        "o_orderkey", S.latest_flowcell_of_map("library_prep").alias("latest_flowcell")
    )


@query(
    """
    SELECT o_orderkey AS project_id, 's' || CAST(i AS VARCHAR) AS sample_id,
      'name' || CAST(o_custkey * i AS VARCHAR) AS customer_name
    FROM orders, (VALUES (1), (2), (3)) AS t(i)
    """
)
def explode_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = []
    for i in (1, 2, 3):
        name = F.concat(F.lit("name"), (F.col("o_custkey") * i).cast("string"))
        pairs += [F.lit(f"s{i}"), F.struct(name.alias("customer_name"))]
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.create_map(*pairs).alias("samples")
    )
    return S.explode_samples(docs, "samples", "project_id").select(
        "project_id", "sample_id", F.col("sample.customer_name").alias("customer_name")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, 'F' || CAST(l_suppkey AS VARCHAR) AS flowcell,
      '/data/' || CAST(l_suppkey AS VARCHAR) || '/' || d AS fastqs,
      CASE l_returnflag WHEN 'A' THEN 'Gene Expression' ELSE 'VDJ' END AS library_type
    FROM lineitem, (VALUES ('one'), ('two')) AS t(d) WHERE l_returnflag IN ('A', 'R')
    """
)
def libraries_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = F.col("l_suppkey").cast("string")
    folders = F.array(
        F.concat(F.lit("/data/"), supplier, F.lit("/one")),
        F.concat(F.lit("/data/"), supplier, F.lit("/two")),
    )
    members = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_returnflag",
        F.create_map(F.concat(F.lit("F"), supplier), folders).alias("fastq_dirs"),
    )
    types = dimension(
        spark,
        "feature STRING, library_type STRING",
        [("A", "Gene Expression"), ("R", "VDJ")],
    )
    return S.libraries_rows(
        members, "l_returnflag", "fastq_dirs", types, "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    """
    SELECT l_orderkey AS project_id, l_linestatus AS origin, count(*) AS n_members,
      string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS features,
      count(DISTINCT l_suppkey) AS n_flowcells
    FROM lineitem GROUP BY 1, 2
    """
)
def group_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        F.col("l_linestatus").alias("origin"),
        "l_returnflag",
        "l_suppkey",
    )
    return S.group_by_origin(
        members, ["project_id", "origin"], "l_returnflag", ["A", "N", "R"], "l_suppkey"
    )


@query(
    """
    SELECT DISTINCT l_orderkey AS project_id, l_linestatus AS origin, l_suppkey AS flowcell FROM lineitem
    """
)
def distinct_flowcells(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        F.col("l_linestatus").alias("origin"),
        F.col("l_suppkey").alias("flowcell"),
    )
    return S.distinct_flowcells(members, ["project_id", "origin"], "flowcell")


@query(
    """
    WITH m AS (SELECT l_orderkey, l_returnflag AS ref_key,
        CASE WHEN l_suppkey % 17 <> 0 THEN 'p' || CAST(l_suppkey % 4 AS VARCHAR) END AS path FROM lineitem),
    k AS (SELECT l_orderkey, ref_key, count(DISTINCT path) > 1 AS c, bool_or(path IS NULL) AS m FROM m GROUP BY 1, 2)
    SELECT l_orderkey, bool_or(c) AS conflict, bool_or(m) AS missing_reference, bool_or(c OR m) AS failed
    FROM k GROUP BY 1
    """
)
def reference_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(
        F.col("l_suppkey") % 17 != 0, F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string"))
    )
    members = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("ref_key"), path.alias("path")
    )
    return S.reference_conflicts(members, ["l_orderkey"], "ref_key", "path")


@query(
    f"""
    WITH t AS (SELECT user_id, arg_max(CASE WHEN event_type = 'signup' THEN '' ELSE {EVENT_STATUS_SQL} END, event_id) AS st,
                 CAST(max(event_id) AS VARCHAR) AS job FROM events GROUP BY user_id)
    SELECT c_custkey AS sample_id, coalesce(nullif(st, ''), 'initialized') AS status,
      CASE WHEN user_id IS NOT NULL THEN job ELSE 'local' END AS job_id
    FROM customer LEFT JOIN t ON c_custkey = user_id
    """
)
def merge_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = case_lookup("event_type", {**EVENT_STATUS, "signup": ""})
    tracking = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("sample_id"))
        .agg(
            F.max_by(status, "event_id").alias("status"),
            F.max("event_id").cast("string").alias("job_id"),
        )
    )
    samples = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample_id"),
        F.lit("initialized").alias("status"),
        F.lit("local").alias("job_id"),
    )
    return S.merge_tracking(samples, tracking, ["sample_id"])


@query(
    """
    WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list(DISTINCT event_type) AS seen FROM events GROUP BY 1, 2),
    m AS (SELECT user_id, day, concat_ws(',',
        CASE WHEN NOT list_contains(seen, 'click') THEN 'click' END,
        CASE WHEN NOT list_contains(seen, 'view') THEN 'view' END,
        CASE WHEN NOT list_contains(seen, 'purchase') THEN 'purchase' END) AS missing FROM s)
    SELECT user_id, day, missing, missing = '' AS valid FROM m
    """
)
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type"
    )
    samples = files.select("user_id", "day").distinct()
    return S.missing_outputs(
        samples, files, ["user_id", "day"], "event_type", ["click", "view", "purchase"]
    )


@query(
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    """
)
def samples_without_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    found = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_custkey").alias("c_custkey"))
    )
    return S.samples_without_fastq(samples, found, ["c_custkey"])


@query(
    """
    WITH e AS (SELECT user_id, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p,
        bool_or(event_type = 'view') AS v FROM events GROUP BY user_id)
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'processing'
        WHEN coalesce(c AND p AND v, false) AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 'completed'
        ELSE 'post_processing_failed' END AS status,
      concat_ws(',', CASE WHEN NOT coalesce(c, false) THEN 'click' END,
        CASE WHEN NOT coalesce(p, false) THEN 'purchase' END, CASE WHEN NOT coalesce(v, false) THEN 'view' END) AS missing,
      CASE WHEN c_custkey % 7 <> 0 THEN '/r/' || CAST(c_custkey AS VARCHAR) || '/web_summary.html' END AS report_path
    FROM customer LEFT JOIN e ON user_id = c_custkey
    """
)
def after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as samples with a log each; their events are the files that exist."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    status = F.when(key % 3 == 0, F.lit("processing")).otherwise(F.lit("processed"))
    report = F.when(
        key % 7 != 0, F.concat(F.lit("- Run summary HTML: /r/"), key.cast("string"), F.lit("/web_summary.html"))
    )
    ending = F.when(key % 5 != 0, F.lit(RUN_SUCCESS_MARKER))
    logs = customers.select(key, F.concat_ws("\n", F.lit("start"), report, ending).alias("text"))
    files = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("file"))
    samples = customers.select(key, status.alias("status"))
    return R.after_run(samples, logs, files, ["c_custkey"], ["click", "purchase", "view"]).drop("run_succeeded")
