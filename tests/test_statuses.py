import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.functions import status as st
from labtables.operators import lifecycle as L


def rollup(spark, statuses, word="completed"):
    projects = spark.createDataFrame([("p",)], "project_id string")
    samples = spark.createDataFrame([("p", s) for s in statuses], "project_id string, status string")
    out = L.project_rollup(projects, samples, "project_id", outputs={"s": word})
    return out.first()["s"]


@pytest.mark.parametrize(
    ("statuses", "expected"),
    [
        (["completed", "processing"], "processing"),
        (["completed", "requires_manual_submission"], "processing"),
        (["completed", "aborted"], "completed"),
        (["pending", "unsequenced"], "pending"),
        (["completed", "failed"], "partially_completed"),
        (["completed", "pending"], "partially_completed"),
        (["running"], "partially_completed"),
        ([None], "partially_completed"),
        (["completed", None], "partially_completed"),
        ([], "completed"),
    ],
)
def test_project_rollup(spark, statuses, expected):
    assert rollup(spark, statuses) == expected


@pytest.mark.parametrize("statuses", [["completed", "aborted"], []])
def test_project_rollup_as_it_is(spark, statuses):
    assert rollup(spark, statuses, "processing") == "processing"


def test_auto_submit_truth_table(spark):
    rows = list(itertools.product([None, True, False], repeat=3))
    df = spark.createDataFrame(rows, "u boolean, d boolean, r boolean")
    found = {
        (r.u, r.d, r.r): r.x for r in df.withColumn("x", st.auto_submit("u", "d", "r")).collect()
    }
    for user, doc, realm in rows:
        expected = user is not True and doc is not False and realm is True
        assert found[(user, doc, realm)] is expected


def test_job_status(spark):
    states = [*S.JOB_END_STATES, "RUNNING", "PENDING", None]
    df = spark.createDataFrame([(s,) for s in states], "s string")
    found = {r.s: r.x for r in df.withColumn("x", st.job_status("s")).collect()}
    assert found["COMPLETED"] == "processed"
    assert all(found[s] == "processing_failed" for s in S.JOB_END_STATES[1:])
    assert found["RUNNING"] is found["PENDING"] is found[None] is None


def test_project_flow(spark):
    words = ["", None, "pending", "partially_completed", "manually_submitted_samples", "completed", "odd"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    found = {r.s: r.x for r in df.withColumn("x", st.project_flow("s")).collect()}
    assert found == {
        "": "main",
        None: "main",
        "pending": "main",
        "partially_completed": "main",
        "manually_submitted_samples": "monitor",
        "completed": "none",
        "odd": "skip",
    }


def test_delivery_rules(spark):
    columns = "pend boolean, pass boolean, pa boolean, ab boolean, rep boolean, signee string, rej boolean, part boolean"
    cases = [
        ((True, True, True, False, True, "x", False, True), "none"),
        ((False, True, True, False, True, "x", False, False), "proceed_delivery"),
        ((False, True, True, False, True, "", False, False), "wait_for_signing"),
        ((False, True, True, False, True, None, False, False), "wait_for_signing"),
        ((False, True, True, False, True, "x", True, False), "wait_for_signing"),
        ((False, True, False, False, None, None, None, True), "generate_report"),
        ((False, False, False, False, None, None, None, True), "finish_no_passed_samples"),
        ((False, True, True, False, None, None, None, False), "generate_report"),
        ((False, True, False, False, None, None, None, False), "finish_some_samples_failed"),
        ((False, False, True, True, None, None, None, False), "finish_all_samples_aborted"),
        ((False, False, False, False, None, None, None, None), "finish_some_samples_failed"),
        ((None, None, None, None, None, None, None, None), "finish_all_samples_aborted"),
    ]
    df = spark.createDataFrame([row for row, _ in cases], columns)
    action = st.delivery_action("pend", "pass", "pa", "ab", "rep", "signee", "rej", "part")
    assert [r.x for r in df.select(action.alias("x")).collect()] == [a for _, a in cases]


def test_delivery_action_labels(spark):
    true, false, none = F.lit(True), F.lit(False), F.lit(None)
    action = st.delivery_action(
        false, true, true, false, none, none, none, true, labels={"generate_report": "make_it"}
    )
    assert spark.range(1).select(action.alias("x")).first().x == "make_it"


def test_current_status_stamps(spark):
    t = [dt.datetime(2025, 1, day) for day in range(1, 8)]
    log = [
        ("a", 1, "pending", t[0]),
        ("a", 2, "pre_processing", t[1]),
        ("a", 3, "processing", t[2]),
        ("a", 4, "processed", t[3]),
        ("a", 5, "post_processing_failed", t[4]),
        ("b", 1, "initialized", t[5]),
    ]
    df = spark.createDataFrame(log, "s string, seq long, status string, ts timestamp_ntz")
    found = {r.s: (r.status, r.start_time, r.end_time) for r in L.current_status(df, ["s"], "status", "seq", "ts").collect()}
    assert found == {"a": ("post_processing_failed", t[2], t[4]), "b": ("initialized", None, None)}


def end_date(statuses):
    """One project's log, step by step."""
    date = None
    for at, status in enumerate(statuses):
        if status in S.SETS_END_DATE:
            date = at if date is None else date
        elif status in S.CLEARS_END_DATE:
            date = None
    return date


@pytest.mark.parametrize("chunk_rows", [1, 3, 7, 1000])
def test_project_end_date_against_stepping(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    words = [*S.SETS_END_DATE, *S.CLEARS_END_DATE, "pending", "pending"]
    logs = {f"p{i}": [] for i in range(30)}
    rows = []
    for seq in range(600):
        project = "p0" if rng.random() < 0.4 else f"p{rng.randrange(30)}"
        status = rng.choice(words)
        logs[project].append((seq, status))
        rows.append((project, seq, status, seq))
    df = spark.createDataFrame(rows, "p string, seq long, status string, ts long")
    found = {r.p: r.end_date for r in L.project_end_date(df, "p", "status", "seq", "ts", chunk_rows).collect()}
    for project, log in logs.items():
        if log:
            at = end_date([s for _, s in log])
            assert found[project] == (None if at is None else log[at][0])
