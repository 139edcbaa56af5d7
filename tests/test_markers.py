import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labtables.operators import markers as M
from labtables.streaming.markers import chain, flowcell_ready, read, summary_of, written

MARKERS = ["RTAComplete.txt", "CopyComplete.txt"]


def watch(names, required):
    """How often the set is completed, file by file."""
    seen, fired = set(), 0
    for name in names:
        if name in required:
            seen.add(name)
            if seen == set(required):
                fired += 1
                seen = set()
    return fired


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(0, n - 1), max_size=60))), st.integers(1, 9))
def test_chained_summaries_equal_stepping(log, size):
    n_markers, files = log
    stretches = []
    for start in range(0, len(files), size):
        part = np.array(files[start : start + size])
        summary = summary_of(part, np.arange(start, start + len(part)), n_markers)
        assert read(written(summary)) == summary
        stretches.append(summary)
    seen, fired = chain(0, stretches, n_markers)
    required = [f"m{k}" for k in range(n_markers)]
    assert fired == watch([required[f] for f in files], required)
    assert seen.bit_count() < n_markers


def log(seed, n=400):
    """One folder gets half of all files."""
    rng = random.Random(seed)
    names = [*MARKERS, "other.txt"]
    return [
        ("i", "hot" if rng.random() < 0.5 else f"f{rng.randrange(20)}", rng.choice(names), seq)
        for seq in range(n)
    ]


def expected(rows):
    folders = {}
    for instrument, folder, file, _ in rows:
        folders.setdefault((instrument, folder), []).append(file)
    counts = {key: watch(files, MARKERS) for key, files in folders.items()}
    return {key: n for key, n in counts.items() if n}


SCHEMA = "instrument string, folder string, file string, seq long"
KEYS = ["instrument", "folder"]


@pytest.mark.parametrize("stretch_rows", [1, 10, 10_000])
def test_completions(spark, stretch_rows):
    rows = log(stretch_rows)
    df = spark.createDataFrame(rows, SCHEMA)
    found = M.completions(df, KEYS, "file", MARKERS, "seq", stretch_rows).collect()
    assert {(r.instrument, r.folder): r.n_events for r in found} == expected(rows)


@pytest.mark.parametrize(("levels", "fan_in"), [(0, 2), (1, 3), (3, 2)])
def test_many_markers_chained_in_levels(spark, levels, fan_in):
    names = [f"m{i}" for i in range(70)]
    rng = random.Random(levels)
    rows = [(rng.choice([None, 2**53 + 1]), rng.choice([*names, "x"]), seq) for seq in range(3000)]
    df = spark.createDataFrame(rows, "folder long, file string, seq long")
    found = M.completions(df, ["folder"], "file", [*names, "m0"], "seq", 250, levels, fan_in).collect()
    logs = {}
    for folder, file, _ in rows:
        logs.setdefault(folder, []).append(file)
    assert {r.folder: r.n_events for r in found} == {k: watch(v, names) for k, v in logs.items()}
    assert min(r.n_events for r in found) > 1


def test_complete_folders(spark):
    rows = log(3, n=60)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.instrument, r.folder) for r in M.complete_folders(df, KEYS, "file", MARKERS).collect()}
    seen = {}
    for instrument, folder, file, _ in rows:
        seen.setdefault((instrument, folder), set()).add(file)
    assert found == {key for key, files in seen.items() if set(MARKERS) <= files}


def test_stream_over_batches_equals_batch(spark, tmp_path):
    rows = log(11)
    for i in range(4):  # four files, in order, one per micro-batch
        part = spark.createDataFrame(rows[i * 100 : (i + 1) * 100], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events = flowcell_ready(files, KEYS, "file", MARKERS, "seq", stretch_rows=10)
    query = (
        events.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    out = spark.read.schema(events.schema).parquet(str(tmp_path / "out"))
    found = out.groupBy(*KEYS).agg(F.sum("n_events").alias("n")).collect()
    assert {(r.instrument, r.folder): r.n for r in found} == expected(rows)


def test_stream_keeps_nulls_and_large_numbers_in_keys(spark, tmp_path):
    rows = [(k, f"m{i % 12}", 20 * i + n) for i in range(24) for n, k in enumerate([None, 2**53 + 1])]
    schema = "folder long, file string, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    required = [f"m{i}" for i in range(12)]
    events = flowcell_ready(files, ["folder"], "file", required, "seq", stretch_rows=100)
    query = (
        events.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    out = spark.read.schema(events.schema).parquet(str(tmp_path / "out")).collect()
    assert {r.folder: r.n_events for r in out} == {None: 2, 2**53 + 1: 2}
