import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labtables.sources import readers as R
from labtables.sources import writers as W
from labtables.sources.snapshots import Snapshot


def lines_of(folder):
    """The lines of a folder's files in name order."""
    files = sorted(p for p in Path(folder).iterdir() if p.name.startswith("part-"))
    return [line for f in files for line in f.read_text().splitlines()]


def test_read_docs(spark, tmp_path):
    docs = [
        {
            "_id": "d1",
            "project_id": "P1",
            "details": {"organism": "human", "sensitive_data": None},
            "samples": {"S1": {"library_prep": {"A": {"barcode": "X-1A", "sequenced_fc": ["20240101_a"]}}}},
        },
        {"_id": "d2"},
    ]
    (tmp_path / "docs.json").write_text("\n".join(json.dumps(d) for d in docs) + "\nnot json\n")
    read = R.read_docs(spark, str(tmp_path))
    rows = {r.doc_id: r.doc for r in read.collect()}
    assert rows["d1"].samples["S1"].library_prep["A"].sequenced_fc == ["20240101_a"]
    assert rows["d2"].details is None
    assert len(rows) == 3 and rows[None] is None or rows[None].project_id is None
    assert R.lookup_doc(read, "d2").count() == 1
    ids = spark.createDataFrame([("d1",), ("nope",)], "doc_id string")
    assert [r.doc_id for r in R.existing_docs(read, ids).select("doc_id").collect()] == ["d1"]


def test_long_stats_fail_per_plate(spark, tmp_path):
    for plate, text in {
        "p1": "RG\tN\ttype\nAC\t5\texon\nbad\t7\texon\n",
        "p2": "RG\tN\ttype\nAC\tnot a number\texon\nAG\t1\texon\n",
        "p3": "RG\tN\ttype\n",
    }.items():
        (tmp_path / plate).mkdir()
        (tmp_path / plate / "readspercell.txt").write_text(text)
    stats, failed = R.read_long_stats(spark, f"{tmp_path}/*/*.txt", "readspercell")
    assert sorted(tuple(r) for r in stats.select("plate", "RG", "N").collect()) == [("p1", "AC", 5), ("p1", "bad", 7)]
    assert sorted(r.plate for r in failed.collect()) == ["p2", "p3"]


def test_long_stats_are_read_by_name(spark, tmp_path):
    for plate, text in {
        "p1": "extra\tnNontagged\tXC\tnUMItag\nz\t100\tAC\t5\n",
        "p2": "XC\tnUMItag\tnNontagged\r\nAC\t6\t7\r\n",
        "p3": "XC\tnUMItag\nAC\t6\n",
    }.items():
        (tmp_path / plate).mkdir()
        (tmp_path / plate / "umi.txt").write_text(text)
    stats, failed = R.read_long_stats(spark, f"{tmp_path}/*/*.txt", "bc_umi_stats")
    rows = sorted(tuple(r) for r in stats.select("plate", "XC", "nUMItag", "nNontagged").collect())
    assert rows == [("p1", "AC", 5, 100), ("p2", "AC", 6, 7)]
    assert [r.plate for r in failed.collect()] == ["p3"]
    (tmp_path / "swapped.csv").write_text("WellID,BCset,XC_NovaSeq,XC\nA1,1A,GT,AC\n")
    lookup = R.read_barcode_lookup(spark, str(tmp_path / "swapped.csv"))
    assert tuple(lookup.select("BCset", "WellID", "XC", "XC_NovaSeq").first()) == ("1A", "A1", "AC", "GT")


def test_malformed_documents_are_kept_apart(spark):
    docs = spark.createDataFrame(
        [("a", '{"x": 1}'), ("b", "{broken"), ("c", None), ("d", "[1]")], "doc_id string, body string"
    )
    assert [r.doc_id for r in R.well_formed_docs(docs).collect()] == ["a"]
    assert sorted(r.doc_id for r in R.malformed_docs(docs).collect()) == ["b", "c", "d"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from labtables.session import scratch_dir

    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session, "x")
    assert "/x" in scratch_dir(spark, "x")


def test_lookup_files_and_logs(spark, tmp_path):
    (tmp_path / "lookup.csv").write_text("BCset,WellID,XC,XC_NovaSeq\n1A,A1,AC,GT\n")
    assert tuple(R.read_barcode_lookup(spark, str(tmp_path / "lookup.csv")).first()) == ("1A", "A1", "AC", "GT")
    folder = tmp_path / "root" / "P1" / "S1" / "run" / "FC1"
    folder.mkdir(parents=True)
    for name in ("S1_S1_R1_001.fastq.gz", "S1_S1_R2_001.fastq.gz", "note.txt"):
        (folder / name).write_text("data")
    files = R.list_files(spark, str(tmp_path / "root"), "*.f*q.gz")
    assert files.columns == ["path", "length", "modificationTime"]
    assert sorted(r.path.split("/")[-1] for r in files.collect()) == ["S1_S1_R1_001.fastq.gz", "S1_S1_R2_001.fastq.gz"]
    found = R.fastq_folders(files).collect()
    assert [(r.project_id, r.sample_id, r.flowcell) for r in found] == [("P1", "S1", "FC1")]
    assert found[0].folder.endswith("/P1/S1/run/FC1")
    (tmp_path / "run.log").write_text("one\ntwo\n")
    log = R.read_logs(spark, str(tmp_path / "run.log")).first()
    assert log.path.endswith("run.log") and log.text == "one\ntwo\n"


def test_count_matrix(spark, tmp_path):
    rows = [("p", "c", "g1", 3), ("p", "c", "g2", 0)]
    spark.createDataFrame(rows, "plate string, cell string, gene string, count long").write.parquet(str(tmp_path / "m"))
    assert sorted(tuple(r) for r in R.read_count_matrix(spark, str(tmp_path / "m")).collect()) == rows
    arrays = spark.createDataFrame([("c", [3, 0])], "cell string, counts array<long>")
    assert sorted(tuple(r) for r in R.explode_counts(arrays, ["cell"], "counts").collect()) == [("c", 0, 3), ("c", 1, 0)]


def test_stats_tsv_and_barcodes(spark, tmp_path):
    stats = spark.createDataFrame([("p", "AC", 3, None), ("q", "AG", 4, 5)], "plate string, bc string, n long, m long")
    W.write_stats_tsv(stats, str(tmp_path / "tsv"), "plate", "bc", ["n", "m"])
    assert lines_of(tmp_path / "tsv" / "plate=p") == ["bc\tn\tm", "AC\t3\t"]
    wells = spark.createDataFrame([("AC", "A1"), ("AG", "A2")], "barcode string, well string").coalesce(1)
    W.write_barcode_list(wells, str(tmp_path / "bc"))
    assert lines_of(tmp_path / "bc") == ["AC", "AG"]


def test_library_and_multi_sheets(spark, tmp_path):
    libraries = spark.createDataFrame(
        [("r1", "/fq/b", "s2", "VDJ"), ("r1", "/fq/a", "s1", "GEX"), ("r2", "/fq/c", "s3", "GEX")],
        "run_sample string, fastqs string, sample string, library_type string",
    )
    W.write_libraries(libraries, str(tmp_path / "lib"), "run_sample")
    sheet = lines_of(tmp_path / "lib" / "run_sample=r1")
    assert sheet[0] == "fastqs,sample,library_type" and sorted(sheet[1:]) == ["/fq/a,s1,GEX", "/fq/b,s2,VDJ"]

    run_samples = libraries.select("run_sample").distinct()
    references = spark.createDataFrame(
        [("r1", "gex", "/ref/g"), ("r1", "vdj", None), ("r2", "vdj", "/ref/v")],
        "run_sample string, ref_key string, ref_path string",
    )
    sections = [("gene-expression", "gex", ["create-bam,false", "x,1"]), ("vdj", "vdj", [])]
    lines = W.multi_sheet_lines(run_samples, libraries, references, "run_sample", sections)
    W.write_multi_sheet(lines, str(tmp_path / "multi"), "run_sample")
    assert lines_of(tmp_path / "multi" / "run_sample=r1") == [
        "[gene-expression]", "reference,/ref/g", "create-bam,false", "x,1", "",
        "[vdj]", "",
        "[libraries]", "fastq_id,fastqs,feature_types", "s1,/fq/a,GEX", "s2,/fq/b,VDJ",
    ]
    assert lines_of(tmp_path / "multi" / "run_sample=r2") == [
        "[gene-expression]", "create-bam,false", "x,1", "",
        "[vdj]", "reference,/ref/v", "",
        "[libraries]", "fastq_id,fastqs,feature_types", "s3,/fq/c,GEX",
    ]


def test_long_sheet_over_several_files_is_in_order(spark, tmp_path):
    libraries = spark.range(5000).select(
        F.lit("r").alias("run_sample"),
        F.lit("/f").alias("fastqs"),
        F.format_string("s%05d", "id").alias("sample"),
        F.lit("GEX").alias("library_type"),
    )
    run_samples = libraries.select("run_sample").distinct()
    none = spark.createDataFrame([], "run_sample string, ref_key string, ref_path string")
    lines = W.multi_sheet_lines(run_samples, libraries, none, "run_sample", [])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        W.write_multi_sheet(lines, str(tmp_path / "m"), "run_sample", max_lines=1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    folder = tmp_path / "m" / "run_sample=r"
    assert len([p for p in folder.iterdir() if p.name.startswith("part-")]) > 1
    assert lines_of(folder) == ["[libraries]", "fastq_id,fastqs,feature_types"] + [f"s{i:05d},/f,GEX" for i in range(5000)]


def snapshot_rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, seq long, v string")


def files_of(root):
    return {str(p): p.stat().st_mtime_ns for p in root.glob("current/*/part-*")}


def test_snapshot_keeps_the_newest_row_of_every_key(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), ["id"], buckets=4)

    def state():
        return {r.id: r.v for r in table.current().collect()}

    table.upsert(snapshot_rows(spark, ("a", 1, "a1"), ("b", 2, "b2"), ("a", 0, "a0")), 0)
    table.upsert(snapshot_rows(spark, ("a", 5, "a5")), 1)
    assert state() == {"a": "a5", "b": "b2"}
    table.upsert(snapshot_rows(spark, ("a", 9, "not again")), 1)  # a replayed batch
    table.upsert(snapshot_rows(spark, ("a", 3, "late"), ("c", 6, "c6")), 2)
    assert state() == {"a": "a5", "b": "b2", "c": "c6"}
    table.upsert(snapshot_rows(spark, ("c", 6, "same seq")))
    table.upsert(snapshot_rows(spark).limit(0), 3)
    assert state() == {"a": "a5", "b": "b2", "c": "same seq"}
    only = spark.createDataFrame([("b",), ("nope",)], "id string")
    assert [tuple(r) for r in table.current(only).select("id", "v").collect()] == [("b", "b2")]
    with pytest.raises(ValueError, match="columns"):
        table.upsert(snapshot_rows(spark, ("a", 10, "x")).withColumn("more", F.lit(1)), 4)
    empty = Snapshot(spark, str(tmp_path / "none"), ["id"])
    assert empty.current(schema="id string, seq long").count() == 0
    with pytest.raises(ValueError, match="nothing"):
        empty.current()


def test_merge_reads_and_writes_touched_folders_only(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), ["id"], buckets=16)
    table.upsert(spark.range(500).selectExpr("CAST(id AS STRING) AS id", "id AS seq", "'x' AS v"), 0)
    before = files_of(tmp_path / "t")
    assert len(before) == 16
    table.upsert(snapshot_rows(spark, ("7", 1000, "new"), ("7", 1001, "newest")), 1)
    after = files_of(tmp_path / "t")
    assert len(after.items() - before.items()) == 1 and len(before.items() - after.items()) == 1
    one = table.current(spark.createDataFrame([("7",)], "id string"))
    assert one.first().v == "newest"
    plan = one._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(bucket" in plan.toString() or "PartitionFilters: [(bucket" in plan.toString()
    assert table.current().count() == 500


def test_failure_while_folders_are_replaced(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), ["id"], buckets=2)
    table.upsert(snapshot_rows(spark, ("a", 1, "a1"), ("b", 2, "b2"), ("c", 3, "c3")), 0)
    table.upsert(snapshot_rows(spark, ("a", 4, "a4")), 1)
    # The job died after folders were removed, before the new ones were in place.
    (tmp_path / "t" / "pending" / "_PLACED").unlink()
    touched = table._touched(snapshot_rows(spark, ("a", 4, "a4")))[0]
    shutil.rmtree(tmp_path / "t" / "current" / f"bucket={touched}")
    again = Snapshot(spark, str(tmp_path / "t"), ["id"], buckets=2)
    again.upsert(snapshot_rows(spark, ("a", 4, "a4")), 1)
    assert {r.id: r.v for r in again.current().collect()} == {"a": "a4", "b": "b2", "c": "c3"}


def test_rows_placed_by_part_of_the_key(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), ["p", "s"], buckets=8, bucket_by=["p"])
    rows = [(f"p{k % 20}", f"s{k}", k) for k in range(200)]
    table.upsert(spark.createDataFrame(rows, "p string, s string, seq long"))
    found = table.current(spark.createDataFrame([("p3",)], "p string"))
    assert {r.s for r in found.collect()} == {f"s{k}" for k in range(200) if k % 20 == 3}


@pytest.mark.parametrize(("max_lines", "one_file"), [(1000, True), (100, False)])
def test_only_long_sheets_are_cut(spark, tmp_path, max_lines, one_file):
    rows = [(f"s{s}", 1, 2, f"{s}-{i:04d}", f"{i:04d}") for s in range(6) for i in range(800)]
    lines = spark.createDataFrame(
        rows, "run_sample string, section_no int, line_no int, line string, _order string"
    ).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        W.write_multi_sheet(lines, str(tmp_path / "out"), "run_sample", max_lines)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    several = 0
    for s in range(6):
        files = sorted((tmp_path / "out" / f"run_sample=s{s}").glob("part-*"))
        text = "".join(f.read_text() for f in files)
        assert text.split() == [f"{s}-{i:04d}" for i in range(800)]
        several += len(files) > 1
    assert (several == 0) == one_file
