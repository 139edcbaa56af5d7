"""Sinks and file sources: write a table out and read it back.

Every run writes to a new scratch folder (the cluster's shared one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.functions import text
from labtables.operators import plate as P
from labtables.plans.bindings._registry import query, table
from labtables.session import scratch_dir
from labtables.sources import readers, snapshots, writers


def _well_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as wells of 25 plates, with event counts and summed values."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        (F.col("user_id") % 25).alias("plate"), F.concat(F.lit("bc"), F.col("user_id").cast("string")).alias("barcode")
    ).agg(
        F.count_if(F.col("event_type") == "click").alias("umi_genes"),
        F.count("*").alias("umi_reads"),
    )


@query(
    """
    SELECT CAST(user_id % 25 AS INTEGER) AS plate, 'bc' || CAST(user_id AS VARCHAR) AS barcode,
      count(*) FILTER (event_type = 'click') AS umi_genes, count(*) AS umi_reads
    FROM events GROUP BY user_id
    """
)
def write_stats_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "stats-tsv")
    writers.write_stats_tsv(
        _well_stats(spark, sf_dir), path, "plate", "barcode", ["umi_genes", "umi_reads"]
    )
    schema = "barcode STRING, umi_genes BIGINT, umi_reads BIGINT, plate INT"
    return spark.read.schema(schema).options(sep="\t", header=True).csv(path)


@query(
    """
    SELECT 'plate=' || CAST(user_id % 25 AS VARCHAR) AS plate, 'bc' || CAST(user_id AS VARCHAR) AS RG, event_type AS type,
      count(*) AS N
    FROM events GROUP BY user_id, event_type
    """
)
def read_long_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "long-stats")
    rows = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(F.count("*").alias("N"))
        .select(
            F.concat(F.lit("bc"), F.col("user_id").cast("string")).alias("RG"),
            "N",
            F.col("event_type").alias("type"),
            (F.col("user_id") % 25).alias("plate"),
        )
    )
    (
        rows.hint("rebalance", "plate")
        .write.partitionBy("plate")
        .options(sep="\t", header=True)
        .csv(path)
    )
    stats, _ = readers.read_long_stats(spark, f"{path}/*/*.csv", "readspercell")
    return stats.select("plate", "RG", "type", "N")


@query("SELECT CAST(p_partkey AS VARCHAR) AS barcode FROM part WHERE p_brand = 'Brand#7'")
def write_barcode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("BCset"), F.col("p_name").alias("WellID"), F.col("p_partkey").alias("XC")
    )
    path = scratch_dir(spark, "barcodes")
    writers.write_barcode_list(P.wells_for_set(lookup, "Brand#7"), path)
    return spark.read.schema("barcode STRING").csv(path)


def _libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as library rows of 25 run samples."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("run_sample"),
        F.concat(F.lit("/fq/"), F.col("l_partkey").cast("string")).alias("fastqs"),
        F.concat_ws("_", F.lit("S"), "l_orderkey", "l_linenumber").alias("sample"),
        F.col("l_returnflag").alias("library_type"),
    )


@query(
    """
    SELECT CAST(l_suppkey % 25 AS INTEGER) AS run_sample, '/fq/' || CAST(l_partkey AS VARCHAR) AS fastqs,
      'S_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS sample, l_returnflag AS library_type
    FROM lineitem
    """
)
def write_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "libraries")
    writers.write_libraries(_libraries(spark, sf_dir), path, "run_sample")
    schema = "fastqs STRING, sample STRING, library_type STRING, run_sample INT"
    return spark.read.schema(schema).options(header=True).csv(path)


@query(
    """
    WITH r AS (SELECT DISTINCT CAST(l_suppkey % 25 AS INTEGER) AS run_sample FROM lineitem)
    SELECT run_sample, line FROM r, (VALUES ('[gene-expression]'), ('create-bam,false'), (''), ('[vdj]'), (''), ('[libraries]'),
        ('fastq_id,fastqs,feature_types')) AS t(line)
    UNION ALL SELECT run_sample, 'reference,/ref/gex' FROM r WHERE run_sample % 2 = 0
    UNION ALL SELECT run_sample, 'reference,/ref/vdj' FROM r WHERE run_sample % 3 = 0
    UNION ALL SELECT CAST(l_suppkey % 25 AS INTEGER), 'S_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)
        || ',/fq/' || CAST(l_partkey AS VARCHAR) || ',' || l_returnflag FROM lineitem
    """
)
def write_multi_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    libraries = _libraries(spark, sf_dir)
    run_samples = libraries.select("run_sample").distinct()

    def reference(key: str, every: int) -> F.Column:
        return F.when(
            F.col("run_sample") % every == 0,
            F.struct(F.lit(key).alias("ref_key"), F.lit(f"/ref/{key}").alias("ref_path")),
        )

    references = run_samples.select(
        "run_sample", F.inline(F.array_compact(F.array(reference("gex", 2), reference("vdj", 3))))
    )
    sections = [("gene-expression", "gex", ["create-bam,false"]), ("vdj", "vdj", [])]
    lines = writers.multi_sheet_lines(run_samples, libraries, references, "run_sample", sections)
    path = scratch_dir(spark, "multi-sheet")
    writers.write_multi_sheet(lines, path, "run_sample")
    back = spark.read.schema("value STRING, run_sample INT").text(path)
    return back.select("run_sample", F.col("value").alias("line"))


@query(
    """
    SELECT o_custkey AS doc_id, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS body
    FROM orders GROUP BY o_custkey
    """
)
def write_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches by order status, whose orders interleave; the second comes twice."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("body"), "o_orderstatus"
    )
    path = scratch_dir(spark, "tracking")
    for batch, status in enumerate("FOOP"):
        part = rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus")
        snapshots.write_tracking(part, path, ["doc_id"], min(batch, 1) + batch // 3, buckets=8)
    return snapshots.Snapshot(spark, path, ["doc_id"], buckets=8).current()


@query("SELECT p_brand AS BCset, p_name AS WellID, CAST(p_partkey AS VARCHAR) AS XC, p_type AS XC_NovaSeq FROM part")
def read_barcode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a lookup whose columns are in another order, with one more."""
    path = scratch_dir(spark, "lookup")
    table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("XC"),
        F.col("p_size").alias("extra"),
        F.col("p_name").alias("WellID"),
        F.col("p_type").alias("XC_NovaSeq"),
        F.col("p_brand").alias("BCset"),
    ).write.options(header=True).csv(path)
    return readers.read_barcode_lookup(spark, f"{path}/*.csv")


@query(
    """
    SELECT DISTINCT 'project=' || CAST(o_custkey % 5 AS VARCHAR) AS project_id, 'sample=' || o_orderstatus AS sample_id,
      'flowcell=' || CAST(o_orderkey % 2 AS VARCHAR) AS flowcell FROM orders
    """
)
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written below project/sample/run/flowcell; the inventory names the folders."""
    path = scratch_dir(spark, "inventory")
    levels = ["project", "sample", "run", "flowcell"]
    table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 5).alias("project"),
        F.col("o_orderstatus").alias("sample"),
        F.lit("r").alias("run"),
        (F.col("o_orderkey") % 2).alias("flowcell"),
        F.col("o_orderpriority").alias("value"),
    ).hint("rebalance", *levels).write.partitionBy(*levels).text(path)
    files = readers.list_files(spark, path, "part-*")
    return readers.fastq_folders(files).select("project_id", "sample_id", "flowcell").distinct()


@query(
    """
    SELECT CAST(user_id % 40 AS INTEGER) AS log, count(*) AS n_lines, bool_or(event_type = 'purchase') AS bought
    FROM events GROUP BY 1
    """
)
def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log files of 40 machines, read whole."""
    path = scratch_dir(spark, "logs")
    table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("log"), F.col("event_type").alias("value")
    ).hint("rebalance", "log").write.partitionBy("log").text(path)
    log = F.regexp_extract("path", "log=([0-9]+)", 1).cast("int")
    lines = F.regexp_count("text", F.lit("\n")).cast("long")
    return (
        readers.read_logs(spark, f"{path}/*/*")
        .groupBy(log.alias("log"))
        .agg(
            F.sum(lines).alias("n_lines"),
            F.bool_or(F.contains("text", F.lit("purchase"))).alias("bought"),
        )
    )


@query(
    """
    SELECT CAST(user_id % 40 AS INTEGER) AS log, bool_or(event_type = 'purchase' AND user_id % 3 = 0) AS succeeded,
      arg_min('/r/' || CAST(event_id AS VARCHAR), event_id) FILTER (event_type = 'signup' AND user_id % 3 = 1) AS report_path,
      coalesce('v' || CAST(max(event_id) FILTER (event_type = 'click' AND user_id % 5 = 0) AS VARCHAR), '--') AS version
    FROM events GROUP BY 1
    """
)
def log_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log files of 40 machines, one file each, read line by line in splits."""
    path = scratch_dir(spark, "log-lines")
    number, kind = F.col("event_id").cast("string"), F.col("event_type")
    line = (
        F.when((kind == "purchase") & (F.col("user_id") % 3 == 0), F.lit("Pipestance completed successfully!"))
        .when((kind == "signup") & (F.col("user_id") % 3 == 1), F.concat(F.lit("Run summary HTML:   /r/"), number))
        .when((kind == "click") & (F.col("user_id") % 5 == 0), F.concat(F.lit("zUMIs version: v"), number, F.lit(" ")))
        .otherwise(kind)
    )
    (
        table(spark, sf_dir, "events")
        .select((F.col("user_id") % 40).alias("log"), "event_id", line.alias("value"))
        .repartition("log")
        .sortWithinPartitions("log", "event_id")
        .select("log", "value")
        .write.partitionBy("log")
        .text(path)
    )
    log = F.regexp_extract("path", "log=([0-9]+)", 1).cast("int")
    return readers.read_log_lines(spark, f"{path}/*/*").groupBy(log.alias("log")).agg(*text.log_facts())
