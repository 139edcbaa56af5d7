"""Plate report operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.functions import plates as wells
from labtables.operators import plate as P
from labtables.plans.bindings._registry import query, table
from labtables.plans.plate_report import PlateInputs, failed_plates, overview, plate_stats
from labtables.sources.readers import explode_counts

EVENT_TYPES = {name: f"n_{name}" for name in ("click", "view", "purchase", "error", "signup")}


def cents(value: str) -> F.Column:
    return F.round(F.col(value) * 100).cast("long")


@query(
    """
    SELECT user_id,
      CAST(sum(CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS n_click,
      CAST(sum(CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS n_view,
      CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS n_purchase,
      CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total
    FROM events GROUP BY user_id
    """
)
def pivot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "events").select(
        "user_id", "event_type", cents("value").alias("n")
    )
    types = {name: EVENT_TYPES[name] for name in ("click", "view", "purchase")}
    return P.pivot_types(long, ["user_id"], "event_type", "n", types, with_total="total")


@query(
    """
    SELECT o_custkey, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total_reads FROM orders
    GROUP BY o_custkey
    """
)
def total_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = (
        table(spark, sf_dir, "orders")
        .select("o_custkey", F.round("o_totalprice").cast("long").alias("n"))
    )
    return P.total_reads(long, ["o_custkey"], "n", "total_reads")


@query(
    """
    SELECT s_suppkey AS plate, n_name AS barcode,
      chr(CAST(65 + n_nationkey // 24 AS INTEGER)) || CAST(n_nationkey % 24 + 1 AS VARCHAR) AS well
    FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey
    """
)
def wells_for_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("set"), F.col("n_regionkey").cast("string")).alias("BCset"),
        wells.well_id("n_nationkey").alias("WellID"),
        F.col("n_name").alias("XC"),
        F.upper("n_name").alias("XC_NovaSeq"),
    )
    plates = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("plate"),
        F.concat(F.lit("set"), (F.col("s_nationkey") % 5).cast("string")).alias("barcode_set"),
    )
    return P.wells_for_plates(plates, lookup)


@query(
    """
    SELECT p_partkey AS barcode, 'W' || CAST(p_size AS VARCHAR) AS well FROM part WHERE p_brand = 'Brand#7'
    """
)
def wells_for_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("BCset"),
        F.concat(F.lit("W"), F.col("p_size").cast("string")).alias("WellID"),
        F.col("p_partkey").alias("XC_NovaSeq"),
    )
    return P.wells_for_set(lookup, "Brand#7", reagent="1.0")


def _stats_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as wells; orders as reads, events as tag counts."""
    well = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("barcode"),
        (F.col("c_custkey") % 7).alias("plate"),
        wells.well_id(F.col("c_custkey") % 384).alias("well"),
    )
    reads = P.total_reads(
        table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("barcode"), F.round("o_totalprice").cast("long").alias("n")
        ),
        ["barcode"],
        "n",
        "total_reads",
    )
    tags = P.pivot_types(
        table(spark, sf_dir, "events").select(
            F.col("user_id").alias("barcode"), "event_type", F.lit(1).cast("long").alias("n")
        ),
        ["barcode"],
        "event_type",
        "n",
        {"click": "tagged", "view": "untagged"},
    )
    return P.join_stats(well, [reads, tags], ["barcode"])


STATS_SQL = """
    r AS (SELECT o_custkey AS k, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total_reads FROM orders GROUP BY 1),
    t AS (SELECT user_id AS k, count(*) FILTER (event_type = 'click') AS tagged,
            count(*) FILTER (event_type = 'view') AS untagged FROM events GROUP BY 1),
    s AS (SELECT c_custkey AS barcode, c_custkey % 7 AS plate,
            chr(CAST(65 + (c_custkey % 384) // 24 AS INTEGER)) || CAST(c_custkey % 24 + 1 AS VARCHAR) AS well,
            total_reads, tagged, untagged
          FROM customer LEFT JOIN r ON c_custkey = r.k LEFT JOIN t ON c_custkey = t.k)
"""


@query(f"WITH {STATS_SQL} SELECT * FROM s")
def join_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_by_customer(spark, sf_dir)


def _stats_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats of all customers but those of plate 3, counts of event users shifted
    so that both sides have rows of their own."""
    stats = _stats_by_customer(spark, sf_dir).where("plate <> 3")
    events = table(spark, sf_dir, "events").select((F.col("user_id") + 100).alias("barcode"), "value")
    counts = events.groupBy("barcode").agg(
        F.count("*").alias("umi_reads"), F.count_if(F.col("value") > 10).alias("umi_genes")
    )
    plate = F.when(F.col("barcode") % 2 == 0, F.col("barcode") % 7).otherwise(F.lit(8).cast("long"))
    return P.join_counts(stats, counts.withColumn("plate", plate), "plate", ["plate", "barcode"])


COUNTS_SQL = STATS_SQL + """,
    c AS (SELECT user_id + 100 AS barcode,
            CASE WHEN (user_id + 100) % 2 = 0 THEN (user_id + 100) % 7 ELSE 8 END AS plate,
            count(*) AS umi_reads, count(*) FILTER (value > 10) AS umi_genes FROM events GROUP BY 1, 2),
    s2 AS (SELECT * FROM s WHERE plate <> 3 AND plate IN (SELECT plate FROM c)),
    c2 AS (SELECT * FROM c WHERE plate IN (SELECT plate FROM s WHERE plate <> 3)),
    j AS (SELECT coalesce(s2.plate, c2.plate) AS plate, coalesce(s2.barcode, c2.barcode) AS barcode,
            well, total_reads, tagged, untagged, umi_reads, umi_genes
          FROM s2 FULL JOIN c2 ON s2.plate = c2.plate AND s2.barcode = c2.barcode)
"""


@query(f"WITH {COUNTS_SQL} SELECT * FROM j")
def join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats_and_counts(spark, sf_dir)


@query(
    f"""
    WITH {COUNTS_SQL},
    n AS (SELECT plate, count(*) * 6 AS n_values,
            6 * count(*) - count(well) - count(total_reads) - count(tagged) - count(untagged)
              - count(umi_reads) - count(umi_genes) AS n_nulls FROM j GROUP BY plate)
    SELECT plate, n_nulls, n_values, round(n_nulls * 100.0 / n_values, 4) AS null_percent,
           n_nulls * 100.0 / n_values <= 30 AS passes FROM n
    """
)
def null_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["well", "total_reads", "tagged", "untagged", "umi_reads", "umi_genes"]
    share = P.null_share(_stats_and_counts(spark, sf_dir), ["plate"], columns, limit=30.0)
    return share.withColumn("null_percent", F.round("null_percent", 4))


EMBEDDING_COUNTS_SQL = """
    SELECT vec_id, label, CAST(sum(g) AS BIGINT) AS umi_reads, count(*) FILTER (g <> 0) AS umi_genes
    FROM (SELECT vec_id, label, CAST(floor(CAST(v AS DOUBLE) * 10) AS BIGINT) AS g
          FROM (SELECT vec_id, label, unnest(embedding) AS v FROM embeddings))
    GROUP BY vec_id, label
    """


def _count_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", counts.alias("counts"))


@query(EMBEDDING_COUNTS_SQL)
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _count_arrays(spark, sf_dir)
    return P.cell_counts(
        cells.select("vec_id", "label"),
        explode_counts(cells, ["vec_id"], "counts"),
        ["vec_id"],
        "count",
    )


@query(EMBEDDING_COUNTS_SQL)
def array_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.array_cell_counts(_count_arrays(spark, sf_dir), ["vec_id", "label"], "counts")


def _part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as wells: 500 per plate over 400 positions, so some wells repeat
    and positions above 383 are no well."""
    key = F.col("p_partkey")
    position = key % 500 % 400
    values = table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 500").alias("plate"),
        F.when(position < 384, wells.well_id(position)).alias("well"),
        "p_partkey",
        F.col("p_size").cast("long").alias("color"),
        cents("p_retailprice").alias("reads"),
    )
    return P.plate_grid(values, "plate", "well", "p_partkey", ["color", "reads"])


GRID_SQL = """
    v AS (SELECT p_partkey // 500 AS plate, p_partkey % 500 % 400 AS i, p_partkey,
            CAST(p_size AS BIGINT) AS color, CAST(round(p_retailprice * 100) AS BIGINT) AS reads FROM part),
    l AS (SELECT plate, i, arg_max(color, p_partkey) AS color, arg_max(reads, p_partkey) AS reads
          FROM v WHERE i < 384 GROUP BY plate, i),
    g AS (SELECT w.plate, CAST(w.i // 24 AS INTEGER) AS row, CAST(w.i % 24 AS INTEGER) AS col,
            coalesce(color, 0) AS color, coalesce(reads, 0) AS reads
          FROM (SELECT plate, i FROM (SELECT DISTINCT plate FROM v), (SELECT unnest(range(384)) AS i)) w
          LEFT JOIN l ON w.plate = l.plate AND w.i = l.i)
"""


@query(f"WITH {GRID_SQL} SELECT * FROM g")
def plate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_grid(spark, sf_dir)


@query(
    f"""
    WITH {GRID_SQL},
    x AS (SELECT plate, row, col, CAST(reads AS DOUBLE) AS v,
            CASE WHEN color > 0 THEN log2(color) END AS w FROM g),
    m AS (SELECT *, min(v) OVER p AS v0, max(v) OVER p AS v1, min(w) OVER p AS w0, max(w) OVER p AS w1
          FROM x WINDOW p AS (PARTITION BY plate))
    SELECT plate, row, col, round((v - v0) / nullif(v1 - v0, 0) * 190 + 10, 4) AS size,
           round((w - w0) / nullif(w1 - w0, 0) * 190 + 10, 4) AS log_size FROM m
    """
)
def scaled_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = P.scaled_size(_part_grid(spark, sf_dir), "plate", "reads")
    both = P.scaled_size(grid, "plate", "color", log=True, out="log_size")
    return both.select(
        "plate", "row", "col", F.round("size", 4).alias("size"), F.round("log_size", 4).alias("log_size")
    )


@query(
    f"""
    WITH {GRID_SQL}
    SELECT plate, min(reads) AS legend_min, CAST(floor(max(reads) / 2) AS BIGINT) AS legend_mid,
           max(reads) AS legend_max FROM g GROUP BY plate
    """
)
def size_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.size_legend(_part_grid(spark, sf_dir), "plate", "reads")


@query(
    """
    WITH p AS (SELECT l_orderkey // 96 AS plate,
        CAST(floor(sum(CAST(l_quantity AS BIGINT) * 40000) / 1000000) AS BIGINT) AS m
      FROM lineitem GROUP BY 1)
    SELECT plate, m AS filtered_reads_m,
      CAST(round_even(CAST(m AS DOUBLE) / 384 * 1000, 2) AS DOUBLE) AS avg_reads_per_cell_k FROM p
    """
)
def plate_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 96").alias("plate"),
        (F.col("l_quantity").cast("long") * 40000).alias("reads"),
    )
    return P.plate_overview(stats, "plate", "reads")


@query(
    """
    WITH t AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS c,
                 count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id)
    SELECT user_id, (v + c) / 2.0 AS seq_reads, round(c * 100.0 / nullif(v + c, 0), 4) AS umi_percent FROM t
    """
)
def umi_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = P.pivot_types(
        table(spark, sf_dir, "events").select(
            "user_id", "event_type", F.lit(1).cast("long").alias("n")
        ),
        ["user_id"],
        "event_type",
        "n",
        {"click": "c", "view": "v"},
    )
    return tags.select(
        "user_id",
        wells.sequenced_reads("c", "v").alias("seq_reads"),
        F.round(wells.umi_percent("c", "v"), 4).alias("umi_percent"),
    )


@query(
    """
    SELECT p_partkey, CASE WHEN i < 384 THEN CAST(i // 24 AS INTEGER) END AS well_row,
      CASE WHEN i < 408 THEN CAST(i % 24 AS INTEGER) END AS well_column
    FROM (SELECT p_partkey, p_partkey % 400 AS i FROM part)
    """
)
def well_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    well = wells.well_id(F.col("p_partkey") % 400)
    return table(spark, sf_dir, "part").select(
        "p_partkey", wells.well_row(well).alias("well_row"), wells.well_column(well).alias("well_column")
    )


@query(
    """
    WITH k AS (SELECT l_suppkey AS plate, l_partkey % 5 * 5 + l_suppkey % 5 AS b, l_returnflag, l_quantity FROM lineitem),
    r AS (SELECT plate, sum(CAST(l_quantity AS BIGINT) * 20000) AS reads FROM k WHERE l_returnflag <> 'R' GROUP BY plate),
    w AS (SELECT s_suppkey AS plate, n_nationkey AS b FROM supplier JOIN nation ON s_suppkey % 5 = n_regionkey),
    g AS (SELECT plate, b, count(*) FILTER (l_returnflag <> 'R') AS n_reads, count(*) AS n FROM k GROUP BY 1, 2),
    x AS (SELECT coalesce(w.plate, g.plate) AS plate, coalesce(w.b, g.b) AS b, w.b IS NULL AS no_well,
            n_reads, n FROM w FULL JOIN g ON w.plate = g.plate AND w.b = g.b),
    gate AS (SELECT plate, sum(CASE WHEN no_well THEN 1 ELSE 0 END
               + CASE WHEN coalesce(n_reads, 0) = 0 OR no_well THEN 1 ELSE 0 END
               + CASE WHEN n IS NULL OR no_well THEN 3 ELSE 0 END
               + CASE WHEN n IS NULL THEN 2 ELSE 0 END) AS nulls, count(*) * 7 AS total
             FROM x GROUP BY plate)
    SELECT gate.plate, CAST(floor(coalesce(reads, 0) / 1000000) AS BIGINT) AS filtered_reads_m,
      CAST(round_even(floor(coalesce(reads, 0) / 1000000) / CAST(384 AS DOUBLE) * 1000, 2) AS DOUBLE) AS avg_reads_per_cell_k
    FROM gate LEFT JOIN r ON gate.plate = r.plate
    WHERE nulls * 100.0 / total <= 10 AND gate.plate IN (SELECT plate FROM k)
    """
)
def plate_report_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report job: suppliers are plates, nations the barcode dimension."""
    stats = plate_stats(_report_inputs(spark, sf_dir), {"A": "exon", "N": "intron"})
    return overview(stats)


def _report_inputs(spark: SparkSession, sf_dir: str) -> PlateInputs:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("plate"),
        (F.col("l_partkey") % 5 * 5 + F.col("l_suppkey") % 5).cast("string").alias("barcode"),
        "l_returnflag",
        "l_quantity",
    )
    nation = table(spark, sf_dir, "nation")
    quantity = F.col("l_quantity").cast("long")
    read_from = F.when(F.col("l_returnflag") == "R", F.lit("bad")).otherwise(F.col("barcode"))
    return PlateInputs(
        plates=table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("plate"), (F.col("s_suppkey") % 5).alias("barcode_set")
        ),
        lookup=nation.select(
            F.col("n_regionkey").alias("BCset"),
            wells.well_id("n_nationkey").alias("WellID"),
            F.col("n_nationkey").cast("string").alias("XC"),
        ),
        reads=lines.select(
            "plate", read_from.alias("barcode"), (quantity * 20000).alias("n"), F.col("l_returnflag").alias("type")
        ),
        genes=lines.select("plate", "barcode", quantity.alias("n"), F.col("l_returnflag").alias("type")),
        umi=lines.groupBy("plate", "barcode").agg(F.count("*").alias("tagged")),
        cells=lines.select("plate", "barcode").distinct(),
        counts=lines.select("plate", "barcode", quantity.alias("count")),
    )


@query(
    """
    SELECT s_suppkey AS plate, s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 0
        AND s_suppkey IN (SELECT l_suppkey FROM lineitem) AS has_stats FROM supplier
    """
)
def plate_report_failed_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates without reads, without genes or with unusable files have no stats at all."""
    whole = _report_inputs(spark, sf_dir)
    inputs = replace(
        whole,
        reads=whole.reads.where("plate % 7 <> 0"),
        genes=whole.genes.where("plate % 5 <> 0"),
        failed=whole.plates.where("plate % 11 = 0").select("plate"),
    )
    stats = plate_stats(inputs, {"A": "exon"}).groupBy("plate").agg(F.lit(True).alias("_has"))
    plates = whole.plates.join(stats, "plate", "left")
    lost = failed_plates(inputs).withColumn("_lost", F.lit(True))
    return plates.join(lost, "plate", "left").select(
        "plate", (F.coalesce("_has", F.lit(False)) & F.col("_lost").isNull()).alias("has_stats")
    )
