"""Keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.operators import upsert as U
from labtables.plans.bindings._registry import query, table


@query(
    """
    WITH x AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS doc_id,
        'order ' || CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS body, o_orderkey
      FROM orders),
    p AS (SELECT doc_id, arg_max(name, o_orderkey) AS name, arg_max(body, o_orderkey) AS body FROM x GROUP BY doc_id)
    SELECT * FROM p
    UNION ALL
    SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM p)
    """
)
def upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("body")
    )
    doc_id = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    changes = (
        table(spark, sf_dir, "orders")
        .select(
            doc_id.alias("doc_id"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
            F.col("o_orderpriority").alias("body"),
            F.col("o_orderkey").alias("seq"),
        )
    )
    patch = U.last_per_key(changes, ["doc_id"], "seq").drop("seq")
    return U.upsert_docs(base, patch, ["doc_id"])


def _sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items reduced to one row per (order, line number): the smallest."""
    best = F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("b")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("sample_id"))
        .agg(best)
        .select("project_id", "sample_id", "b.*")
    )


@query(
    """
    WITH r AS (SELECT l_orderkey AS project_id, l_linenumber AS sample_id, l_partkey, l_suppkey, l_returnflag,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag) AS rn FROM lineitem),
    d AS (SELECT * FROM r WHERE rn = 1),
    b AS (SELECT * FROM d WHERE l_returnflag <> 'R'), p AS (SELECT * FROM d WHERE l_returnflag <> 'N'),
    j AS (SELECT coalesce(b.project_id, p.project_id) AS project_id, coalesce(b.sample_id, p.sample_id) AS sample_id,
        b.project_id IS NOT NULL AS has_b, p.project_id IS NOT NULL AS has_p,
        coalesce(b.l_suppkey, p.l_suppkey) AS sk, coalesce(b.l_partkey, p.l_partkey) AS pk, coalesce(b.l_returnflag, p.l_returnflag) AS rf
      FROM b FULL JOIN p ON b.project_id = p.project_id AND b.sample_id = p.sample_id)
    SELECT project_id, sample_id, CASE WHEN has_p THEN 'status ' || rf ELSE 'completed' END AS status,
      CASE WHEN has_b THEN 'j' || CAST(pk AS VARCHAR) ELSE '' END AS job_id,
      CASE WHEN has_p AND rf = 'A' THEN 'new start' WHEN has_b THEN 'old start' ELSE '' END AS start_time,
      CASE WHEN has_p AND rf = 'R' THEN 'new end' WHEN has_b THEN 'old end' ELSE '' END AS end_time,
      CASE WHEN has_b AND has_p THEN list_aggregate(list_sort(list_distinct(['fc' || CAST(sk % 10 AS VARCHAR), 'fc' || CAST(pk % 10 AS VARCHAR)])), 'string_agg', ',')
           WHEN has_b THEN 'fc' || CAST(sk % 10 AS VARCHAR)
           ELSE list_aggregate(list_sort(list_distinct(['fc' || CAST(sk % 10 AS VARCHAR), 'fc' || CAST(pk % 10 AS VARCHAR)])), 'string_agg', ',') END AS flowcells,
      CASE WHEN has_b THEN 'Passed' ELSE '' END AS qc, has_b AS delivered
    FROM j
    """
)
def upsert_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sample_rows(spark, sf_dir)

    def flowcell(column: str) -> F.Column:
        return F.concat(F.lit("fc"), (F.col(column) % 10).cast("string"))

    base = rows.where("l_returnflag <> 'R'").select(
        "project_id",
        "sample_id",
        F.lit("completed").alias("status"),
        F.concat(F.lit("j"), F.col("l_partkey").cast("string")).alias("job_id"),
        F.lit("old start").alias("start_time"),
        F.lit("old end").alias("end_time"),
        F.array(flowcell("l_suppkey")).alias("flowcells"),
        F.lit("Passed").alias("qc"),
        F.lit(True).alias("delivered"),
    )
    patch = rows.where("l_returnflag <> 'N'").select(
        "project_id",
        "sample_id",
        F.concat(F.lit("status "), "l_returnflag").alias("status"),
        F.lit(None).cast("string").alias("job_id"),
        F.when(F.col("l_returnflag") == "A", F.lit("new start")).alias("start_time"),
        F.when(F.col("l_returnflag") == "R", F.lit("new end")).otherwise(F.lit("")).alias("end_time"),
        F.array(flowcell("l_partkey"), flowcell("l_suppkey")).alias("flowcells"),
    )
    merged = U.upsert_samples(base, patch, ["project_id", "sample_id"])
    return merged.withColumn("flowcells", F.array_join(F.array_sort("flowcells"), ","))


@query(
    """
    SELECT l_orderkey AS project_id, 'fc' || CAST(l_suppkey AS VARCHAR) AS flowcell FROM lineitem WHERE l_returnflag = 'A'
    UNION
    SELECT l_orderkey, 'fc' || CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_returnflag <> 'A'
    """
)
def flowcell_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        F.concat(F.lit("fc"), F.col("l_suppkey").cast("string")).alias("flowcell"),
        "l_returnflag",
    )
    known = rows.where("l_returnflag = 'A'").drop("l_returnflag")
    new = rows.where("l_returnflag <> 'A'").drop("l_returnflag")
    return U.flowcell_union(known, new)


@query(
    """
    WITH b AS (SELECT c_custkey AS project_id, 'pi' AS role, 'email' AS key, 'pi' || CAST(c_custkey AS VARCHAR) AS value FROM customer
      UNION ALL SELECT c_custkey, 'pi', 'name', c_name FROM customer
      UNION ALL SELECT c_custkey, 'owner', 'name', c_mktsegment FROM customer),
    p AS (SELECT c_custkey AS project_id, 'pi' AS role, 'email' AS key, '' AS value FROM customer WHERE c_mktsegment = 'BUILDING'
      UNION ALL SELECT c_custkey, 'lab', 'name', 'lab ' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT * FROM p UNION ALL
    SELECT b.* FROM b LEFT JOIN p ON b.project_id = p.project_id AND b.role = p.role AND b.key = p.key WHERE p.project_id IS NULL
    """
)
def upsert_user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")

    def entry(role: str, key: str, value: F.Column) -> F.Column:
        return F.struct(F.lit(role).alias("role"), F.lit(key).alias("key"), value.alias("value"))

    pi_email = F.concat(F.lit("pi"), F.col("c_custkey").cast("string"))
    base = customers.select(
        F.col("c_custkey").alias("project_id"),
        F.inline(
            F.array(
                entry("pi", "email", pi_email),
                entry("pi", "name", F.col("c_name")),
                entry("owner", "name", F.col("c_mktsegment")),
            )
        ),
    )
    lab = F.concat(F.lit("lab "), F.col("c_nationkey").cast("string"))
    patch = customers.select(
        F.col("c_custkey").alias("project_id"),
        F.inline(
            F.array(
                F.when(
                    F.col("c_mktsegment") == "BUILDING", entry("pi", "email", F.lit(None).cast("string"))
                ).otherwise(entry("lab", "name", lab))
            )
        ),
    )
    return U.upsert_user_info(base, patch, ["project_id", "role", "key"])


@query(
    """
    SELECT c_custkey AS project_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'pi' END AS pi_email,
      c_name AS pi_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'lab' END AS lab_name FROM customer
    """
)
def merge_user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge inside one document's role map."""
    building = F.col("c_mktsegment") == "BUILDING"

    def entry(key: str, value: F.Column) -> F.Column:
        return F.create_map(F.lit(key), value)

    old = F.create_map(
        F.lit("pi"), F.create_map(F.lit("email"), F.lit("pi"), F.lit("name"), F.col("c_name"))
    )
    new = F.when(
        building, F.create_map(F.lit("pi"), entry("email", F.lit(None).cast("string")))
    ).otherwise(F.create_map(F.lit("lab"), entry("name", F.lit("lab"))))
    info = U.merge_user_info(old, new)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.try_element_at(F.try_element_at(info, F.lit("pi")), F.lit("email")).alias("pi_email"),
        F.try_element_at(F.try_element_at(info, F.lit("pi")), F.lit("name")).alias("pi_name"),
        F.try_element_at(F.try_element_at(info, F.lit("lab")), F.lit("name")).alias("lab_name"),
    )


@query(
    """
    WITH t AS (SELECT o_custkey, bool_and(o_orderstatus <> 'O') AS done FROM orders GROUP BY 1)
    SELECT c_custkey AS project_id, CASE WHEN o_custkey IS NULL THEN 'insert' WHEN done THEN 'skip' ELSE 'sync' END AS action,
      o_custkey IS NULL OR NOT done AS proceed
    FROM customer LEFT JOIN t ON c_custkey = o_custkey
    """
)
def init_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.bool_and(F.col("o_orderstatus") != "O")
    tracking = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("project_id"))
        .agg(F.when(done, F.lit("completed")).otherwise(F.lit("ongoing")).alias("project_status"))
    )
    incoming = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    return U.init_projects(incoming, tracking, "project_id")


# Events as single-field patches of customers; two kinds of field, and blank
# statuses that are refused.
PATCH_SQL = """
    p AS (SELECT CASE WHEN event_id % 9 = 0 THEN user_id + 1000000 ELSE user_id END AS sample_id, event_id,
        CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'status' ELSE 'qc' END AS field,
        CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'completed' WHEN 'signup' THEN ''
          WHEN 'purchase' THEN 'Passed' END AS value FROM events)
"""


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (
        F.when(F.col("event_type") == "click", "processing")
        .when(F.col("event_type") == "view", "completed")
        .when(F.col("event_type") == "signup", "")
        .when(F.col("event_type") == "purchase", "Passed")
    )
    field = F.when(F.col("event_type").isin("click", "view", "signup"), F.lit("status")).otherwise(F.lit("qc"))
    sample = F.when(F.col("event_id") % 9 == 0, F.col("user_id") + 1000000).otherwise(F.col("user_id"))
    return table(spark, sf_dir, "events").select(
        sample.alias("sample_id"), "event_id", field.alias("field"), value.alias("value")
    )


@query(
    f"""
    WITH {PATCH_SQL},
    s AS (SELECT sample_id, arg_max(value, event_id) AS st FROM p WHERE field = 'status' AND value <> '' GROUP BY 1),
    q AS (SELECT sample_id, max(event_id) AS e FROM p WHERE field = 'qc' GROUP BY 1)
    SELECT c_custkey AS sample_id, coalesce(st, 'pending') AS status,
      CASE WHEN q.sample_id IS NULL THEN 'none' ELSE p.value END AS qc,
      CASE WHEN st = 'processing' THEN 'now' ELSE '' END AS start_time,
      CASE WHEN st = 'completed' THEN 'now' ELSE '' END AS end_time
    FROM customer LEFT JOIN s ON c_custkey = s.sample_id LEFT JOIN q ON c_custkey = q.sample_id
    LEFT JOIN p ON p.event_id = q.e
    """
)
def update_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample_id"),
        F.lit("pending").alias("status"),
        F.lit("none").alias("qc"),
        F.lit("").alias("start_time"),
        F.lit("").alias("end_time"),
    )
    return U.update_field(
        samples, _patches(spark, sf_dir), ["sample_id"], ["status", "qc"], "event_id", F.lit("now")
    )


@query(
    f"""
    WITH {PATCH_SQL}
    SELECT sample_id, event_id, field, value FROM p
    WHERE sample_id NOT IN (SELECT c_custkey FROM customer) OR (field = 'status' AND coalesce(value, '') = '')
    """
)
def rejected_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    return U.rejected_patches(samples, _patches(spark, sf_dir), ["sample_id"], ["status", "qc"])
