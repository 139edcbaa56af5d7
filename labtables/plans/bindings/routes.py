"""Routing: realms, decision table, references, handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.operators import routing as R
from labtables.plans.bindings._registry import query, table
from labtables.sources.dimensions import dimension
from labtables.streaming.dispatch import Realms

# In order: an exact entry, overlapping prefixes, a key without the prefix flag.
RULES = [
    R.Rule("red widget", "exact_widget"),
    R.Rule("red", "red_realm", prefix=True),
    R.Rule("small b", "small_b_realm", prefix=True),
    R.Rule("small", "small_realm", prefix=True),
    R.Rule("small bolt", "exact_bolt"),
    R.Rule("hot", "never_by_prefix"),
    R.Rule("Blue", "wrong_case", prefix=True),
    R.Rule("old", "old_realm", prefix=True),
]

ROUTE_SQL = """CASE WHEN p_name = 'red widget' THEN 'exact_widget'
    WHEN p_name = 'small bolt' THEN 'exact_bolt' WHEN p_name = 'hot' THEN 'never_by_prefix'
    WHEN p_name LIKE 'red%' THEN 'red_realm' WHEN p_name LIKE 'small b%' THEN 'small_b_realm'
    WHEN p_name LIKE 'small%' THEN 'small_realm' WHEN p_name LIKE 'Blue%' THEN 'wrong_case'
    WHEN p_name LIKE 'old%' THEN 'old_realm' END"""

ROUTED_SQL = f"""
    SELECT p_partkey, p_name, target
    FROM (SELECT p_partkey, p_name, {ROUTE_SQL} AS target FROM part) WHERE target IS NOT NULL
    """


@query(ROUTED_SQL)
def route_exact_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.route(parts, "p_name", RULES)


@query(ROUTED_SQL)
def route_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = dimension(
        spark,
        "pos INT, key STRING, target STRING, is_prefix BOOLEAN",
        [(i, r.key, r.target, r.prefix) for i, r in enumerate(RULES)],
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.route_by_table(parts, "p_name", registry)


@query(
    f"""
    SELECT p_name, count(*) AS n_rows FROM part WHERE ({ROUTE_SQL}) IS NULL GROUP BY p_name
    """
)
def route_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unrouted(table(spark, sf_dir, "part"), "p_name", RULES)


@query(
    """
    SELECT p_partkey AS sample_id, 'red' AS family, p_size AS amount FROM part
    WHERE p_name LIKE 'red%' AND p_name <> 'red widget'
    UNION ALL
    SELECT p_partkey, 'old', 2 * p_size FROM part WHERE p_name LIKE 'old%' AND p_size > 10
    """
)
def realms_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    realms = Realms()
    realms.register_realm(
        "red_realm",
        lambda docs: docs.select(
            F.col("p_partkey").alias("sample_id"),
            F.lit("red").alias("family"),
            F.col("p_size").alias("amount"),
        ),
    )
    realms.register_realm(
        "old_realm",
        lambda docs: docs.select(
            F.col("p_partkey").alias("sample_id"),
            F.lit("old").alias("family"),
            (F.col("p_size") * 2).alias("amount"),
        ),
        finalize=lambda samples: samples.where("amount > 20"),
    )
    return realms.apply(table(spark, sf_dir, "part"), "p_name", RULES)


# The second entry repeats the first one's key and must never win.
DECISIONS = [
    R.Decision("1-URGENT", ("A", "R"), {"workflow": "multi", "submit": True}),
    R.Decision("1-URGENT", ("R", "A"), {"workflow": "shadowed", "submit": False}),
    R.Decision("1-URGENT", ("A",), {"workflow": "count", "submit": True}),
    R.Decision("2-HIGH", ("A", "N", "R"), {"workflow": "all", "submit": False}),
    R.Decision("5-LOW", ("N",), {"workflow": "low", "submit": True}),
]


@query(
    """
    WITH g AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS features
               FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, o_orderpriority, features,
      CASE WHEN o_orderpriority = '1-URGENT' AND features = 'A,R' THEN 'multi'
           WHEN o_orderpriority = '1-URGENT' AND features = 'A' THEN 'count'
           WHEN o_orderpriority = '2-HIGH' AND features = 'A,N,R' THEN 'all'
           WHEN o_orderpriority = '5-LOW' AND features = 'N' THEN 'low' END AS workflow,
      CASE WHEN o_orderpriority = '1-URGENT' AND features IN ('A,R', 'A') THEN true
           WHEN o_orderpriority = '2-HIGH' AND features = 'A,N,R' THEN false
           WHEN o_orderpriority = '5-LOW' AND features = 'N' THEN true END AS submit
    FROM orders JOIN g ON o_orderkey = l_orderkey
    """
)
def decision_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = R.feature_sets(
        table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"),
        ["o_orderkey"],
        "l_returnflag",
        DECISIONS,
    )
    groups = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(
        sets, "o_orderkey"
    )
    return R.match_decision_table(groups, "o_orderpriority", DECISIONS, ["workflow", "submit"])


@query(
    """
    WITH fk(feature, ref_key) AS (VALUES ('A', 'gex'), ('R', 'vdj')),
    refs(ref_key, organism, path) AS (VALUES ('gex', 'PROMO', '/ref/promo'), ('gex', 'SMALL', '/ref/small'),
      ('vdj', 'PROMO', '/ref/vdj_promo'), ('atac', 'LARGE', '/ref/atac'))
    SELECT l_orderkey, l_linenumber, l_partkey, fk.ref_key, refs.path AS ref_path
    FROM lineitem JOIN part ON l_partkey = p_partkey
    LEFT JOIN fk ON l_returnflag = fk.feature
    LEFT JOIN refs ON fk.ref_key = refs.ref_key AND p_type = refs.organism
    """
)
def reference_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature_keys = dimension(
        spark, "feature STRING, ref_key STRING", [("A", "gex"), ("R", "vdj")]
    )
    references = dimension(
        spark,
        "ref_key STRING, organism STRING, path STRING",
        [
            ("gex", "PROMO", "/ref/promo"),
            ("gex", "SMALL", "/ref/small"),
            ("vdj", "PROMO", "/ref/vdj_promo"),
            ("atac", "LARGE", "/ref/atac"),
        ],
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    samples = lines.join(parts, "l_partkey")
    return R.reference_for(samples, "l_returnflag", "p_type", feature_keys, references).select(
        "l_orderkey", "l_linenumber", "l_partkey", "ref_key", "ref_path"
    )


@query(
    """
    SELECT event_type, CASE event_type WHEN 'click' THEN 'on_click' WHEN 'view' THEN 'on_view'
        WHEN 'purchase' THEN 'on_purchase' END AS handler, count(*) AS n_events
    FROM events GROUP BY event_type
    """
)
def event_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    handlers = {"click": "on_click", "view": "on_view", "purchase": "on_purchase"}
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count("*").alias("n_events"))
        .withColumn("handler", R.event_target("event_type", handlers))
    )
