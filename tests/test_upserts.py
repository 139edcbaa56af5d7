from pyspark.sql import functions as F

from labtables.operators import delivery as D
from labtables.operators import samples as SM
from labtables.operators import upsert as U

SAMPLE = (
    "project_id string, sample_id string, status string, job_id string, start_time string, "
    "end_time string, flowcells array<string>, qc string, delivered boolean"
)
PATCH = "project_id string, sample_id string, status string, job_id string, start_time string, end_time string, flowcells array<string>"
KEYS = ["project_id", "sample_id"]


def test_upsert_samples(spark):
    base = spark.createDataFrame(
        [
            ("p", "s1", "pending", "1", "t0", "", ["FC001"], "Passed", True),
            ("p", "s2", "pending", "2", "t0", "t1", ["FC001"], "Failed", False),
            ("q", "s1", "pending", "3", "t0", "", None, "", False),
        ],
        SAMPLE,
    )
    patch = spark.createDataFrame(
        [
            ("p", "s1", "completed", "99", None, "t9", ["FC002", "FC001"]),
            ("q", "s1", "running", None, "t5", "", []),
            ("p", "s3", "initialized", None, None, None, ["FC003"]),
        ],
        PATCH,
    )
    out = {(r.project_id, r.sample_id): r for r in U.upsert_samples(base, patch, KEYS, F.lit("now")).collect()}
    assert len(out) == 4
    known = out["p", "s1"]
    assert (known.status, known.job_id, known.start_time, known.end_time) == ("completed", "1", "t0", "t9")
    assert sorted(known.flowcells) == ["FC001", "FC002"]
    assert (known.qc, known.delivered) == ("Passed", True)
    assert out["p", "s2"].status == "pending" and out["p", "s2"].flowcells == ["FC001"]
    assert out["q", "s1"].start_time == "t5" and out["q", "s1"].flowcells is None
    new = out["p", "s3"]
    assert (new.status, new.job_id, new.qc, new.delivered, new.end_time) == ("initialized", "", "", False, "")
    assert new.start_time == "now"


def test_upsert_docs_replaces_whole_rows(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n long, t string")
    patch = spark.createDataFrame([(None, "b", 5), ("z", "c", None)], "t string, id string, n long")
    found = {tuple(r) for r in U.upsert_docs(base, patch, ["id"]).collect()}
    assert found == {("a", 1, "x"), ("b", 5, None), ("c", None, "z")}


def test_upserting_twice_changes_nothing(spark):
    base = spark.createDataFrame([("a", 1)], "id string, n long")
    patch = spark.createDataFrame([("a", 2), ("b", 3)], "id string, n long")
    once = U.upsert_docs(base, patch, ["id"])
    twice = U.upsert_docs(once, patch, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_merge_user_info(spark):
    df = spark.sql(
        """SELECT map('pi', map('email', 'a', 'name', 'n'), 'owner', map('email', 'o')) AS old,
                  map('pi', map('email', CAST(NULL AS STRING), 'phone', '1'), 'lab', map('name', CAST(NULL AS STRING))) AS new"""
    )
    assert df.select(U.merge_user_info("old", "new").alias("x")).first().x == {
        "pi": {"email": "", "name": "n", "phone": "1"},
        "owner": {"email": "o"},
        "lab": {"name": ""},
    }


def test_update_field(spark):
    samples = spark.createDataFrame(
        [("a", "pending", "", "", "j0"), ("b", "pending", "", "", "j0"), ("c", "pending", "", "", "j0")],
        "id string, status string, start_time string, end_time string, job_id string",
    )
    patches = spark.createDataFrame(
        [
            ("a", "status", "processing", 1),
            ("a", "job_id", "j1", 2),
            ("a", "job_id", None, 3),
            ("b", "status", "completed", 4),
            ("b", "status", "", 5),
            ("x", "status", "completed", 6),
            ("c", "job_id", "j2", 7),
        ],
        "id string, field string, value string, seq long",
    )
    out = U.update_field(samples, patches, ["id"], ["status", "job_id"], "seq", F.lit("now"))
    assert {r.id: tuple(r)[1:] for r in out.collect()} == {
        "a": ("processing", "now", "", None),
        "b": ("completed", "", "now", "j0"),
        "c": ("pending", "", "", "j2"),
    }
    rejected = U.rejected_patches(samples, patches, ["id"])
    assert sorted(r.seq for r in rejected.collect()) == [5, 6]


def test_init_projects(spark):
    incoming = spark.createDataFrame([("new",), ("done",), ("open",)], "project_id string")
    tracking = spark.createDataFrame([("done", "completed"), ("open", None)], "project_id string, project_status string")
    found = {r.project_id: (r.action, r.proceed) for r in U.init_projects(incoming, tracking, "project_id").collect()}
    assert found == {"new": ("insert", True), "done": ("skip", False), "open": ("sync", True)}


def test_merge_tracking(spark):
    samples = spark.createDataFrame([(s, "initialized", "old") for s in "abcd"], "id string, status string, job_id string")
    tracking = spark.createDataFrame(
        [("a", "completed", "1"), ("b", "", "2"), ("c", None, None)], "id string, status string, job_id string"
    )
    found = {r.id: (r.status, r.job_id) for r in SM.merge_tracking(samples, tracking, ["id"]).collect()}
    assert found == {
        "a": ("completed", "1"),
        "b": ("initialized", "2"),
        "c": ("initialized", None),
        "d": ("initialized", "old"),
    }


def test_missing_outputs(spark):
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    files = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("b", "other")], "id string, file string"
    )
    found = {r.id: (r.missing, r.valid) for r in SM.missing_outputs(samples, files, ["id"], "file", ["x", "y"]).collect()}
    assert found == {"a": ("", True), "b": ("x", False), "c": ("x,y", False)}


def test_reference_conflicts(spark):
    rows = {
        "ok": [("gex", "/a"), ("gex", "/a"), ("vdj", "/b")],
        "conflict": [("gex", "/a"), ("gex", "/b")],
        "missing": [("gex", "/a"), ("gex", None)],
        "none": [(None, None)],
        "both": [("gex", "/a"), ("gex", "/b"), ("vdj", None)],
    }
    df = spark.createDataFrame([(k, *r) for k, rs in rows.items() for r in rs], "s string, ref_key string, path string")
    out = SM.reference_conflicts(df, ["s"], "ref_key", "path")
    assert {r.s: (r.conflict, r.missing_reference, r.failed) for r in out.collect()} == {
        "ok": (False, False, False),
        "conflict": (True, False, True),
        "missing": (False, True, True),
        "none": (False, True, True),
        "both": (True, True, True),
    }


def test_latest_flowcell_first_met_wins_a_tie(spark):
    rows = [("a", "20240101_x", 1), ("a", "240101_y", 2), ("a", "bad", 0), ("b", "bad", 1), ("c", "231231_z", 1), ("c", "20240101_w", 2)]
    df = spark.createDataFrame(rows, "s string, flowcell string, ordinal long")
    found = {r.s: r.latest_flowcell for r in SM.latest_flowcell(df, ["s"]).collect()}
    assert found == {"a": "20240101_x", "c": "20240101_w"}


def test_latest_flowcell_in_a_document(spark):
    df = spark.sql(
        """SELECT map('A', named_struct('barcode', 'x', 'sequenced_fc', array('bad', '240101_a')),
                      'B', named_struct('barcode', 'y', 'sequenced_fc', CAST(NULL AS ARRAY<STRING>)),
                      'C', named_struct('barcode', 'z', 'sequenced_fc', array('20240101_b', '231231_c'))) AS m
           UNION ALL SELECT CAST(NULL AS MAP<STRING, STRUCT<barcode: STRING, sequenced_fc: ARRAY<STRING>>>)"""
    )
    latest = SM.latest_flowcell_of_map("m")
    assert [r.x for r in df.select(latest.alias("x")).collect()] == ["240101_a", None]


def test_deliver_marks_and_counts(spark):
    samples = spark.createDataFrame(
        [("p", "1", "Passed", False), ("p", "2", "Passed", True), ("p", "3", "Failed", None), ("q", "1", "", False)],
        "project_id string, sample_id string, qc string, delivered boolean",
    )
    marked = {(r.project_id, r.sample_id): r.delivered for r in D.mark_delivered(samples).collect()}
    assert marked == {("p", "1"): True, ("p", "2"): True, ("p", "3"): False, ("q", "1"): False}
    projects = spark.createDataFrame([("p", "D1"), ("q", None), ("r", None)], "project_id string, dds_project_id string")
    entries = {r.project_id: (r.dds_project_id, r.n_included) for r in D.delivery_entries(projects, samples, "project_id").collect()}
    assert entries == {"p": ("D1", 1), "q": ("DDS123", 0), "r": ("DDS123", 0)}
    now = D.delivered_now(samples, "project_id", "sample_id", "qc", "delivered").collect()
    assert [tuple(r) for r in now] == [("p", "1")]


def test_references_outside_the_known_keys(spark):
    df = spark.createDataFrame(
        [("s1", "gex", "/a"), ("s1", "new", "/b"), ("s2", "new", "/a"), ("s2", "new", "/b")],
        "s string, ref_key string, path string",
    )
    out = SM.reference_conflicts(df, ["s"], "ref_key", "path")
    assert {r.s: r.conflict for r in out.collect()} == {"s1": False, "s2": True}


def test_outputs_beyond_62_and_repeated_names(spark):
    names = [f"f{k}" for k in range(70)]
    samples = spark.createDataFrame([("s1",), ("s2",)], "s string")
    files = spark.createDataFrame(
        [("s1", n) for n in names] + [("s2", n) for n in names[:69]], "s string, file string"
    )
    out = SM.missing_outputs(samples, files, ["s"], "file", [*names, "f0"])
    assert {r.s: (r.missing, r.valid) for r in out.collect()} == {"s1": ("", True), "s2": ("f69", False)}


def test_marker_names_may_repeat(spark):
    from labtables.operators.markers import complete_folders

    files = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "a")], "k string, file string")
    assert [r.k for r in complete_folders(files, ["k"], "file", ["a", "b", "a"]).collect()] == ["k"]
