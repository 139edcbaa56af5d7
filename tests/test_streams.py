import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.operators.lifecycle import current_status
from labtables.operators.routing import Rule
from labtables.plans.follow_projects import follow_projects, project_table, rejected, sample_table
from labtables.session import scratch_dir
from labtables.streaming import changes as C
from labtables.streaming.dispatch import Dispatcher
from labtables.streaming.rollup import follow_rollup, rolled_up, sample_deltas


def add(spark, path, rows, schema=S.RAW_DOC):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_follow_documents_resumes_after_the_last_change(spark, tmp_path):
    feed, checkpoint = tmp_path / "feed", str(tmp_path / "cp")
    seen = []

    def catch_up():
        def note(batch, batch_id):
            seen.append({r.doc_id: r.body for r in batch.collect()})

        query = C.follow_documents(C.read_changes(spark, str(feed)), checkpoint, note)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    def state():
        return {r.doc_id: (r.seq, r.body) for r in C.latest_documents(spark, checkpoint).collect()}

    add(spark, feed, [("a", 1, "{}"), ("a", 3, '{"v":3}'), ("b", 2, None)])
    assert catch_up() >= 3
    assert state() == {"a": (3, '{"v":3}'), "b": (2, None)}
    assert catch_up() == 0
    add(spark, feed, [("a", 2, '{"late":1}'), ("b", 4, '{"v":4}'), ("c", 5, "{}")])
    catch_up()
    assert state() == {"a": (3, '{"v":3}'), "b": (4, '{"v":4}'), "c": (5, "{}")}
    assert [batch for batch in seen if batch][-1] == {"a": '{"v":3}', "b": '{"v":4}', "c": "{}"}


def test_feed_from_a_sequence_number(spark, tmp_path):
    feed, checkpoint = tmp_path / "feed", str(tmp_path / "cp")

    def catch_up():
        changes = C.read_changes(spark, str(feed), since=2)
        C.follow_documents(changes, checkpoint).awaitTermination()
        return {r.doc_id: r.seq for r in C.latest_documents(spark, checkpoint).collect()}

    add(spark, feed, [("a", 1, "{}"), ("b", 2, "{}"), ("c", 3, "{}")])
    assert catch_up() == {"c": 3}
    add(spark, feed, [("a", 4, "{}")])
    assert catch_up() == {"c": 3, "a": 4}


def test_follow_routed_keeps_rejects(spark, tmp_path):
    feed, checkpoint = tmp_path / "feed", str(tmp_path / "cp")
    rules = [Rule("10X", "droplet"), Rule("MARS", "mars", prefix=True)]
    batches = []

    def catch_up():
        C.follow_routed(
            C.read_changes(spark, str(feed)),
            rules,
            "$.details.m",
            checkpoint,
            lambda batch, batch_id: batches.append({r.doc_id: r.target for r in batch.collect()}),
        ).awaitTermination()
        routed, rejects = C.routed_documents(spark, checkpoint, rules, "$.details.m")
        return {r.doc_id: r.target for r in routed.collect()}, {r.doc_id for r in rejects.collect()}

    add(
        spark,
        feed,
        [
            ("a", 1, '{"details":{"m":"10X"}}'),
            ("b", 2, '{"details":{"m":"MARS-seq"}}'),
            ("c", 3, '{"details":{"m":"none"}}'),
            ("d", 4, "{}"),
        ],
    )
    assert catch_up() == ({"a": "droplet", "b": "mars"}, {"c", "d"})
    add(spark, feed, [("c", 5, '{"details":{"m":"10X"}}'), ("a", 6, None)])
    assert catch_up() == ({"b": "mars", "c": "droplet"}, {"d"})
    assert [batch for batch in batches if batch][-1] == {"c": "droplet"}


STATUS_LOG = "p string, s string, status string, seq long, ts timestamp"


def at(minute):
    return datetime(2024, 1, 1, 12, minute)


def test_status_stream_in_any_order_of_batches(spark, tmp_path):
    rows = [
        ("p", "1", "processing", 1, at(1)),
        ("p", "2", "completed", 2, at(2)),
        ("q", "1", "pending", 3, at(3)),
        ("q", "1", "initialized", 4, at(4)),
        ("p", "1", "completed", 5, at(5)),
        ("p", "2", "running", 6, at(6)),
        ("p", "2", "aborted", 7, at(7)),
    ]
    expected = {
        (r.p, r.s): (r.status, r.start_time, r.end_time)
        for r in current_status(spark.createDataFrame(rows, STATUS_LOG), ["p", "s"], "status", "seq", "ts").collect()
    }
    for number, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 2, 0])):
        folder = tmp_path / str(number)
        for part in order:
            add(spark, folder / "log", rows[part::3], STATUS_LOG)
            log = C.read_changes(spark, str(folder / "log"), STATUS_LOG)
            C.follow_status(log, ["p", "s"], "status", "seq", "ts", str(folder / "cp")).awaitTermination()
        samples = C.current_statuses(spark, str(folder / "cp"))
        assert {(r.p, r.s): (r.status, r.start_time, r.end_time) for r in samples.collect()} == expected
        projects = {r.p: r.project_status for r in C.tracked_projects(samples, "p").collect()}
        assert projects == {"p": "completed", "q": "processing"}


def step_through(rows):
    """Status and end date of every project after each row, one at a time."""
    held, out = {}, {}
    for project, sample, status, seq, ts in rows:
        held.setdefault(project, {})[sample] = status
        found = set(held[project].values())
        if found & set(S.ROLLUP_ACTIVE):
            rolled = "processing"
        elif found <= set(S.ROLLUP_FINISHED):
            rolled = "completed"
        elif found <= set(S.ROLLUP_NOT_STARTED):
            rolled = "pending"
        else:
            rolled = "partially_completed"
        end = out.get(project, (None, None, None))[2]
        if rolled in S.SETS_END_DATE:
            end = end or ts
        elif rolled in S.CLEARS_END_DATE:
            end = None
        out[project] = (len(held[project]), rolled, end)
    return out


def test_rollup_and_end_date_after_every_change(spark, tmp_path):
    rng = random.Random(2)
    words = ["processing", "completed", "completed", "aborted", "failed", "pending", "unsequenced", "processing_failed"]
    rows = [
        (f"p{rng.randrange(6)}", f"s{rng.randrange(3)}", rng.choice(words), k, at(0) + timedelta(seconds=k))
        for k in range(400)
    ]
    for n, stop in enumerate((150, 151, 400)):
        part = rows[(0, 150, 151)[n] : stop]
        add(spark, tmp_path / "log", part, STATUS_LOG)
        log = C.read_changes(spark, str(tmp_path / "log"), STATUS_LOG)
        follow_rollup(log, "p", "s", "status", "seq", "ts", str(tmp_path / "kept"))
        found = rolled_up(spark, str(tmp_path / "kept")).collect()
        assert {r.project: (r.n_samples, r.project_status, r.end_date) for r in found} == step_through(rows[:stop])


def test_rollup_ignores_late_rows(spark, tmp_path):
    rows = [("p", "1", "completed", 5, at(5)), ("p", "2", "processing", 2, at(2))]
    late = [("p", "1", "processing", 1, at(1)), ("p", "2", "completed", 9, at(9)), ("p", "2", None, 8, at(8))]
    for part in (rows, late):
        add(spark, tmp_path / "log", part, STATUS_LOG)
        log = C.read_changes(spark, str(tmp_path / "log"), STATUS_LOG)
        follow_rollup(log, "p", "s", "status", "seq", "ts", str(tmp_path / "kept"))
    (row,) = rolled_up(spark, str(tmp_path / "kept")).collect()
    assert (row.n_samples, row.n_active, row.n_finished, row.project_status) == (2, 0, 2, "completed")
    # Only what a batch touched is written again.
    assert spark.read.parquet(str(tmp_path / "kept" / "projects")).count() == 2


def test_rollup_of_a_project_of_many_frames(spark, tmp_path):
    """More rows than one frame holds, in no order; a state is kept per slice, not per sample."""
    rows = [("p", f"s{k % 300}", ("processing", "failed")[k >= 700], k, at(0) + timedelta(seconds=k)) for k in range(1000)]
    random.Random(3).shuffle(rows)
    add(spark, tmp_path / "log", rows, STATUS_LOG)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        log = C.read_changes(spark, str(tmp_path / "log"), STATUS_LOG)
        deltas = sample_deltas(log, "p", "s", "status", "seq", "ts", slices=5)
        checkpoint = str(tmp_path / "deltas")
        C.run(deltas, lambda batch, _: batch.write.format("noop").mode("append").save(), checkpoint).awaitTermination()
        follow_rollup(log, "p", "s", "status", "seq", "ts", str(tmp_path / "kept"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.read.format("statestore").load(checkpoint).count() <= 5
    (row,) = rolled_up(spark, str(tmp_path / "kept")).collect()
    assert {"p": (row.n_samples, row.project_status, row.end_date)} == step_through(sorted(rows, key=lambda r: r[3]))


def test_dispatcher(spark, tmp_path):
    events = [("flowcell_ready", "1", "s"), ("project_change", "2", "s"), ("delivery_ready", "3", "s"), ("flowcell_ready", "4", "s")]
    schema = "event_type string, payload string, source string"
    dispatcher = Dispatcher()
    seen = []
    with pytest.raises(ValueError):
        dispatcher.register_handler("made_up", lambda rows, batch: None)
    dispatcher.register_handler("flowcell_ready", lambda rows, batch: seen.append("replaced"))
    dispatcher.register_handler("flowcell_ready", lambda rows, batch: seen.append(sorted(r.payload for r in rows.collect())))

    def broken(rows, batch):
        raise KeyError("broken")

    dispatcher.register_handler("project_change", broken)
    add(spark, tmp_path / "events", events, schema)
    stream = C.read_changes(spark, str(tmp_path / "events"), schema)
    dispatcher.start(stream, str(tmp_path / "cp"), str(tmp_path / "errors")).awaitTermination()
    assert seen == [["1", "4"]]
    errors = spark.read.parquet(str(tmp_path / "errors")).collect()
    assert [(r.event_type, r.error) for r in errors] == [("project_change", "KeyError: 'broken'")]
    unhandled = dispatcher.unhandled(spark.createDataFrame(events, schema)).collect()
    assert [(r.event_type, r.n_rows) for r in unhandled] == [("delivery_ready", 1)]


class SharedFolder:
    """A session on a cluster that names a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return "hdfs://shared/cp/" if key == "spark.checkpoint.dir" else default


def test_scratch_follows_the_shared_folder(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    assert scratch_dir(SharedFolder, "x").startswith("hdfs://shared/cp/labtables/x-")


def test_polling_trigger(spark, tmp_path):
    add(spark, tmp_path / "feed", [("a", 1, "{}")])
    got = []
    query = C.run(
        C.read_changes(spark, str(tmp_path / "feed")),
        lambda batch, batch_id: got.append(batch.agg(F.count("*")).first()[0]),
        str(tmp_path / "cp"),
        poll_seconds=1,
    )
    query.processAllAvailable()
    query.stop()
    assert sum(got) == 1


def project_doc(project, owner, sensitive, flowcells):
    return json.dumps(
        {
            "_id": f"doc-{project}",
            "project_id": project,
            "project_name": project,
            "details": {"library_construction_method": "10X", "sensitive_data": sensitive},
            "order_details": {"owner": {"email": owner, "name": "O"}, "fields": {}},
            "samples": {
                name: {"details": {}, "library_prep": {"A": {"barcode": "b", "sequenced_fc": fcs}}}
                for name, fcs in flowcells.items()
            },
        }
    )


def test_follow_projects_merges_with_what_is_tracked(spark, tmp_path):
    projects = project_table(spark, str(tmp_path / "projects"), buckets=4)
    samples = sample_table(spark, str(tmp_path / "samples"), buckets=4)
    feed, rules = tmp_path / "feed", [Rule("10X", "droplet")]

    def catch_up():
        follow_projects(
            C.read_changes(spark, str(feed)),
            rules,
            ["project_id"],
            projects,
            samples,
            str(tmp_path / "cp"),
            sample_required=["library_prep"],
            now=F.lit("now"),
        ).awaitTermination()
        return (
            {r.project_id: r for r in projects.current().collect()},
            {(r.project_id, r.sample_id): (r.flowcell, r.status) for r in samples.current().collect()},
        )

    add(
        spark,
        feed,
        [
            ("doc-p", 1, project_doc("p", "old@x", "yes", {"s1": ["20240101_a"], "s2": []})),
            ("doc-q", 2, project_doc("q", "q@x", "no", {"s1": []})),
            ("doc-r", 3, json.dumps({"_id": "doc-r", "project_name": "no id"})),
            ("doc-s", 3, project_doc("s", "s@x", "no", {"s1": []}).replace("library_prep", "prep")),
        ],
    )
    tracked, rows = catch_up()
    assert {p: (r.project_status, r.sensitive) for p, r in tracked.items()} == {"p": ("ongoing", True), "q": ("ongoing", False)}
    assert rows == {("p", "s1"): ("20240101_a", "initialized"), ("p", "s2"): (None, "unsequenced"), ("q", "s1"): (None, "unsequenced")}

    # Meanwhile others work on p and complete q; then both documents change.
    done = projects.current().where("project_id = 'q'").withColumn("project_status", F.lit("completed"))
    projects.upsert(done.withColumn("seq", F.lit(4).cast("long")))
    moved = samples.current().where("project_id = 'p' AND sample_id = 's1'")
    moved = moved.withColumn("status", F.lit("processing")).withColumn("job_id", F.lit("77"))
    moved = moved.withColumns({"start_time": F.lit("t1"), "qc": F.lit("Passed"), "delivered": F.lit(True)})
    samples.upsert(moved.withColumn("seq", F.lit(5).cast("long")))
    add(
        spark,
        feed,
        [
            ("doc-p", 7, project_doc("p", "new@x", "no", {"s1": ["20240101_a", "20240301_b"], "s3": ["231231_c"]})),
            ("doc-q", 8, project_doc("q", "other@x", "yes", {"s1": ["20240101_a"]})),
        ],
    )
    tracked, rows = catch_up()
    p, q = tracked["p"], tracked["q"]
    assert (p.project_status, p.sensitive, p.user_info["owner"]["email"]) == ("ongoing", False, "new@x")
    assert (q.project_status, q.sensitive, q.user_info["owner"]["email"]) == ("completed", False, "q@x")
    assert rows == {
        ("p", "s1"): ("20240301_b", "processing"),
        ("p", "s2"): (None, "unsequenced"),
        ("p", "s3"): ("231231_c", "initialized"),
        ("q", "s1"): (None, "unsequenced"),
    }
    kept = {(r.project_id, r.sample_id): r for r in samples.current().collect()}
    worked, new = kept["p", "s1"], kept["p", "s3"]
    assert sorted(worked.flowcells) == ["20240101_a", "20240301_b"]
    assert (worked.job_id, worked.start_time, worked.end_time, worked.qc, worked.delivered) == ("77", "t1", "", "Passed", True)
    assert (new.job_id, new.start_time, new.end_time, new.qc, new.delivered) == ("", "now", "", "", False)
    lost = rejected(spark, str(tmp_path / "cp"), rules, ["project_id"], ["library_prep"]).collect()
    assert {(r.doc_id, r.reason, r.detail) for r in lost} == {
        ("doc-r", "incomplete", "project_id"),
        ("doc-s", "incomplete", "samples.s1.library_prep"),
    }


def test_customers_are_dealt_out_before_they_become_documents(spark, sf_dir, monkeypatch):
    from labtables.plans.bindings import streams

    monkeypatch.setattr(streams, "TASK_DOCS", 10)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    docs = streams._customer_docs(spark, sf_dir, customers)
    assert docs.rdd.getNumPartitions() == -(-customers.count() // 10)
    assert docs.count() == customers.count()
