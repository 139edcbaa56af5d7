"""Run samples: orders are projects, line items lab samples, three origins per order."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.operators import routing as R
from labtables.plans import run_samples as RS
from labtables.plans.bindings._registry import query, table
from labtables.sources.dimensions import dimension

METHODS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")  # the fourth priority has no pipeline
FEATURES = ("A", "N", "R")


def _decisions(spark: SparkSession) -> DataFrame:
    """A decision for every method and set of features, each repeated later in another order."""
    rows = []
    for method in METHODS:
        for size in (1, 2, 3):
            for words in combinations(FEATURES, size):
                file = "multi_csv" if size > 1 else "libraries_csv"
                name = f"{method[0]}:{','.join(words)}"
                rows.append((method, list(words), name, method != "5-LOW", f"other,{file}"))
    rows += [(m, f[::-1] + f[:1], "shadowed", False, "") for m, f, *_ in rows]
    schema = "pos INT, method STRING, features ARRAY<STRING>, pipeline STRING, submit BOOLEAN, files_to_generate STRING"
    return dimension(spark, schema, [(pos, *row) for pos, row in enumerate(rows)])


#: Line items of a task: as many tasks as it takes, so that none grows with the table.
TASK_ROWS = 200_000


def _inputs(spark: SparkSession, sf_dir: str) -> RS.RunInputs:
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    sample = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey")
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS))
    lines = lines.repartition(tasks, "l_orderkey")
    methods = orders.select("o_orderkey", F.col("o_orderpriority").alias("method")).repartition(tasks, "o_orderkey")
    members = lines.join(methods, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("project_id"),
        F.concat(F.lit("run"), (line % 3).cast("string")).alias("run_sample"),
        sample.alias("sample_id"),
        "method",
        F.col("l_returnflag").alias("feature"),
        F.when(part % 23 == 0, "mouse").when(part % 29 == 0, "unknown").otherwise("human").alias("organism"),
        F.when(part % 17 == 0, "Aborted").alias("manual_status"),
    )
    # Distinct numbers make distinct names.
    sequenced = lines.where(F.col("l_suppkey") % 19 != 0).select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    inventory = sequenced.select(
        F.col("l_orderkey").alias("project_id"),
        sample.alias("sample_id"),
        F.lit("fc").alias("flowcell"),
        F.concat(F.lit("/fq/"), sample).alias("folder"),
    )
    keys = [("A", "gex"), ("N", "vdj"), ("R", "gex")]
    paths = [(key, organism, f"/ref/{key}/{organism}") for key in ("gex", "vdj") for organism in ("human", "mouse")]
    types = [("A", "Gene Expression"), ("N", "VDJ")]
    return RS.RunInputs(
        members,
        inventory,
        dimension(spark, "feature STRING, ref_key STRING", keys),
        dimension(spark, "ref_key STRING, organism STRING, path STRING", paths),
        dimension(spark, "feature STRING, library_type STRING", types),
        _decisions(spark),
        tasks,
    )


RUNS_SQL = """
    m AS (SELECT l_orderkey AS project_id, 'run' || CAST(l_linenumber % 3 AS VARCHAR) AS run_sample,
        concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS sample_id, o_orderpriority AS method,
        l_returnflag AS feature, l_suppkey % 19 <> 0 AS has_fastq, CASE l_returnflag WHEN 'N' THEN 'vdj' ELSE 'gex' END AS ref_key,
        CASE WHEN l_partkey % 23 = 0 THEN 'mouse' WHEN l_partkey % 29 = 0 THEN NULL ELSE 'human' END AS ref
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 17 <> 0),
    c AS (SELECT project_id, run_sample, bool_or(n > 1) AS conflict FROM
        (SELECT project_id, run_sample, ref_key, count(DISTINCT ref) AS n FROM m GROUP BY ALL) GROUP BY ALL),
    g AS (SELECT project_id, run_sample, max(method) AS method, count(*) AS n_members,
        string_agg(DISTINCT feature, ',' ORDER BY feature) AS features, bool_or(ref IS NULL) AS missing, bool_and(has_fastq) AS has_fastq
      FROM m GROUP BY ALL),
    p AS (SELECT g.*, conflict, CASE WHEN method <> '4-NOT SPECIFIED' THEN left(method, 1) || ':' || features END AS pipeline,
        CASE WHEN method <> '4-NOT SPECIFIED' THEN method <> '5-LOW' END AS submit,
        CASE WHEN method <> '4-NOT SPECIFIED' THEN CASE WHEN len(features) > 1 THEN 'other,multi_csv' ELSE 'other,libraries_csv' END END
          AS files_to_generate
      FROM g JOIN c USING (project_id, run_sample)),
    r AS (SELECT project_id, run_sample, method, n_members, features, pipeline, submit, files_to_generate,
        CASE WHEN missing OR conflict THEN 'failed' WHEN NOT has_fastq OR pipeline IS NULL THEN 'pre_processing_failed'
          ELSE 'pre_processed' END AS status,
        CASE WHEN missing THEN 'missing reference' WHEN conflict THEN 'conflicting references'
          WHEN NOT has_fastq THEN 'missing FASTQ files' WHEN pipeline IS NULL THEN 'no pipeline' END AS reason FROM p),
    l AS (SELECT m.project_id, m.run_sample, '/fq/' || sample_id AS fastqs, sample_id AS sample,
        CASE feature WHEN 'A' THEN 'Gene Expression' ELSE 'VDJ' END AS library_type, r.files_to_generate, ref_key, ref, feature
      FROM m JOIN r USING (project_id, run_sample) WHERE status = 'pre_processed')
"""


@query(f"WITH {RUNS_SQL} SELECT * FROM r")
def run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RS.run_samples(_inputs(spark, sf_dir))


@query(
    f"""
    WITH {RUNS_SQL}
    SELECT project_id, run_sample, fastqs, sample, library_type FROM l
    WHERE files_to_generate = 'other,libraries_csv' AND feature <> 'R'
    """
)
def run_sample_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _inputs(spark, sf_dir)
    return RS.library_rows(inputs, RS.run_samples(inputs))


@query(
    f"""
    WITH {RUNS_SQL},
    s AS (SELECT CAST(project_id AS VARCHAR) || '_' || run_sample AS run, * FROM l WHERE files_to_generate = 'other,multi_csv')
    SELECT run, section_no, line_no, line FROM (SELECT DISTINCT run FROM s),
      (VALUES (0, 0, '[gene-expression]'), (0, 2, 'create-bam,false'), (0, 3, ''), (1, 0, '[vdj]'), (1, 2, ''),
        (2, 0, '[libraries]'), (2, 1, 'fastq_id,fastqs,feature_types')) AS t(section_no, line_no, line)
    UNION ALL SELECT DISTINCT run, CASE ref_key WHEN 'gex' THEN 0 ELSE 1 END, 1, 'reference,/ref/' || ref_key || '/' || ref FROM s
    UNION ALL SELECT run, 2, 2, sample || ',' || fastqs || ',' || library_type FROM s WHERE feature <> 'R'
    """
)
def run_sample_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _inputs(spark, sf_dir)
    sections = [("gene-expression", "gex", ["create-bam,false"]), ("vdj", "vdj", [])]
    lines = RS.sheet_lines(inputs, RS.run_samples(inputs), sections)
    return lines.drop("_order")


@query(
    """
    WITH g AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS features FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_orderpriority, features,
      CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN left(o_orderpriority, 1) || ':' || features END AS pipeline
    FROM orders JOIN g ON o_orderkey = l_orderkey
    """
)
def decision_rows_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table as a table, joined."""
    decisions = _decisions(spark)
    members = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    sets = R.feature_sets(members, ["o_orderkey"], "l_returnflag", decisions)
    groups = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(sets, "o_orderkey")
    return R.match_decision_table(groups, "o_orderpriority", decisions, ["pipeline"])
