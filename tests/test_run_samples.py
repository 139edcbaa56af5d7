"""Run-sample preparation, case by case."""

from dataclasses import replace

from labtables.operators.routing import Decision
from labtables.plans import run_samples as RS

MEMBERS = "project_id string, run_sample string, sample_id string, method string, feature string, organism string, manual_status string"


def inputs(spark, members, without=()):
    rows = [("p", run, sample, "10X", feature, organism, manual) for run, sample, feature, organism, manual in members]
    folders = [("p", r[2], "fc", f"/fq/{r[2]}") for r in rows if r[2] not in without]
    gex = {"pipeline": "count", "submit": True, "files_to_generate": "libraries_csv,feature_ref_csv"}
    both = {"pipeline": "multi", "submit": False, "files_to_generate": "multi_csv"}
    return RS.RunInputs(
        spark.createDataFrame(rows, MEMBERS),
        spark.createDataFrame(folders, "project_id string, sample_id string, flowcell string, folder string"),
        spark.createDataFrame([("gex", "gex"), ("cite", "gex"), ("vdj", "vdj")], "feature string, ref_key string"),
        spark.createDataFrame(
            [("gex", "human", "/h"), ("gex", "mouse", "/m"), ("vdj", "human", "/v")], "ref_key string, organism string, path string"
        ),
        spark.createDataFrame([("gex", "Gene Expression"), ("vdj", "VDJ")], "feature string, library_type string"),
        [Decision("10X", ("gex",), gex), Decision("10X", ("gex", "vdj"), both)],
    )


def test_statuses_and_sheets(spark):
    members = [
        ("good", "g1", "gex", "human", None),
        ("good", "g2", "gex", "human", "ok"),
        ("good", "g3", "vdj", "human", "Aborted"),  # aborted, so the set is {gex}
        ("multi", "m1", "gex", "human", ""),
        ("multi", "m2", "vdj", "human", None),
        ("conflict", "c1", "gex", "human", None),
        ("conflict", "c2", "gex", "mouse", None),
        ("noref", "n1", "vdj", "mouse", None),
        ("foreign", "f1", "atac", "human", None),
        ("nofastq", "q1", "gex", "human", None),
        ("nofastq", "q2", "gex", "human", None),
        ("nopipe", "x1", "cite", "human", None),
        ("gone", "z1", "gex", "human", "aborted"),
    ]
    given = inputs(spark, members, without=("q2", "c1"))
    runs = RS.run_samples(given)
    found = {r.run_sample: (r.status, r.reason, r.pipeline, r.n_members) for r in runs.collect()}
    assert found == {
        "good": ("pre_processed", None, "count", 2),
        "multi": ("pre_processed", None, "multi", 2),
        "conflict": ("failed", "conflicting references", "count", 2),
        "noref": ("failed", "missing reference", None, 1),
        "foreign": ("failed", "missing reference", None, 1),
        "nofastq": ("pre_processing_failed", "missing FASTQ files", "count", 2),
        "nopipe": ("pre_processing_failed", "no pipeline", None, 1),
    }
    rows = {tuple(r) for r in RS.library_rows(given, runs).collect()}
    assert rows == {("p", "good", f"/fq/{s}", s, "Gene Expression") for s in ("g1", "g2")}
    sections = [("gex", "gex", ["x,1"]), ("vdj", "vdj", [])]
    lines = RS.sheet_lines(given, runs, sections).orderBy("section_no", "line_no", "_order").collect()
    assert [r.line for r in lines] == [
        "[gex]", "reference,/h", "x,1", "", "[vdj]", "reference,/v", "",
        "[libraries]", "fastq_id,fastqs,feature_types", "m1,/fq/m1,Gene Expression", "m2,/fq/m2,VDJ",
    ]
    assert {r.run for r in lines} == {"p_multi"}


def test_nothing_to_prepare(spark):
    given = inputs(spark, [("gone", "z1", "gex", "human", "ABORTED")])
    assert RS.run_samples(given).count() == 0


def test_large_tables_keep_the_tasks_asked_for(spark):
    """Small compressed shuffles are not joined up to few tasks, and the result is the same."""
    members = [(f"r{k % 20}", f"s{k}", ("gex", "vdj")[k % 2], "human", None) for k in range(60)]
    given = inputs(spark, members, without=("s3",))
    dealt = replace(given, tasks=7)
    runs, plain = RS.run_samples(dealt), RS.run_samples(given)
    assert runs.rdd.getNumPartitions() == RS.library_rows(dealt, runs).rdd.getNumPartitions() == 7
    assert sorted(runs.collect()) == sorted(plain.collect()) and plain.count() == 20
    found = sorted(RS.library_rows(dealt, runs, "multi_csv").collect())
    assert found == sorted(RS.library_rows(given, plain, "multi_csv").collect())
