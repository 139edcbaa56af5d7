"""Project status and end date, kept up to date by every change of a sample's status.

Two queries.  The first holds each sample's status and turns a status row into a delta: its
project's counters less the old status, plus the new.  The second adds the deltas up per
project and follows the project's status and end date through them.  A batch costs what it
changes; neither the samples nor the projects are read again.

A status row older than what its sample has is late and changes nothing, so the counters equal
the batch roll-up after any order of batches.  The end date follows the changes in the order in
which batches bring them (by ``seq`` within a batch).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labtables import schemas as S
from labtables.functions._cols import case_lookup
from labtables.functions.status import rollup_status

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Classes of a sample's status, as numbers: active, finished, not started, none of these.
CLASSES = (S.ROLLUP_ACTIVE, S.ROLLUP_FINISHED, S.ROLLUP_NOT_STARTED)
OTHER = len(CLASSES)
COUNTERS = ["n_samples", "n_active", "n_finished", "n_not_started"]


def status_class(status: Column) -> Column:
    numbers = {word: F.lit(k) for k, words in enumerate(CLASSES) for word in words}
    return case_lookup(status, numbers, F.lit(OTHER))


def sample_deltas(
    log: DataFrame, project: str, sample: str, status: str, seq: str, ts: str, slices: int = 1024
) -> DataFrame:
    """Stream of (project, seq, ts, was, becomes): a sample's class before and after a row.

    ``was`` is null for a sample's first row.  Rows that do not change the class are left out.
    Samples are dealt into ``slices``, and the state is one map per slice, as handing over a
    state for each sample costs milliseconds.  A slice should hold no more than some ten
    thousand samples; their number is fixed by the first batch.
    """
    ids = F.to_json(F.struct(F.col(project).alias("p"), F.col(sample).alias("s")))
    rows = log.select(
        ids.alias("_key"),
        F.pmod(F.xxhash64(project, sample), F.lit(slices)).cast("int").alias("slice"),
        F.col(project).cast("string").alias("project"),
        F.col(seq).cast("long").alias("seq"),
        F.col(ts).cast("timestamp").alias("ts"),
        status_class(F.col(status)).cast("int").alias("becomes"),
    )

    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames), ignore_index=True)
        codes, names = pd.factorize(rows["_key"])
        known = np.array([name in held for name in names])
        last, before = np.array([held.get(name, (0, -1)) for name in names], dtype=np.int64).T
        fresh = ~known[codes] | (rows["seq"] > last[codes]).to_numpy(dtype=bool)
        rows, codes = rows[fresh], codes[fresh]
        if not len(rows):
            return
        seq = rows["seq"].to_numpy().astype(np.int64)
        order = np.lexsort((seq, codes))
        rows, codes, seq = rows.iloc[order], codes[order], seq[order]
        becomes = rows["becomes"].to_numpy().astype(np.int64)
        first = np.diff(codes, prepend=-1) != 0
        was = np.where(first, before[codes], np.roll(becomes, 1))
        ends = np.roll(first, -1)
        ends[-1] = True
        for name, *now in zip(names[codes[ends]], seq[ends].tolist(), becomes[ends].tolist(), strict=True):
            held[name] = now
        state.update((json.dumps(held),))
        changed = was != becomes
        rows = rows.assign(was=pd.arrays.IntegerArray(was.astype(np.int32), was < 0))
        yield rows[changed][["project", "seq", "ts", "was", "becomes"]]

    return rows.groupBy("slice").applyInPandasWithState(
        step,
        "project STRING, seq BIGINT, ts TIMESTAMP, was INT, becomes INT",
        "held STRING",
        "append",
        GroupStateTimeout.NoTimeout,
    )


#: What setting and clearing the end date does to it, by project status.
_SETS, _CLEARS = 1, -1


def _statuses(counts: np.ndarray, finished: int) -> np.ndarray:
    """Effect on the end date of the status after each row of counters."""
    n, active, done, idle = counts.T
    effect = np.full(len(counts), _SETS)  # partially completed
    effect[idle == n] = 0  # pending
    effect[done == n] = finished
    effect[active > 0] = _CLEARS  # processing
    return effect


def project_rollups(deltas: DataFrame, finished_as: str = "completed") -> DataFrame:
    """Stream of (project, counters.., end_date, seq) of every project that a batch touched."""
    effect_of = {word: _SETS for word in S.SETS_END_DATE} | {word: _CLEARS for word in S.CLEARS_END_DATE}
    finished = effect_of.get(finished_as, 0)

    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        *before, end, upto = state.get if state.exists else (0, 0, 0, 0, None, 0)
        counts, end = np.array(before, dtype=np.int64), None if end is None else pd.Timestamp(end, unit="us")
        # A large project comes in several frames, which have no order among them.
        rows = pd.concat([frame[["seq", "ts", "was", "becomes"]] for frame in frames], ignore_index=True)
        rows = rows.sort_values("seq", kind="stable")
        change = np.zeros((len(rows), len(COUNTERS)), dtype=np.int64)
        was, becomes = rows["was"].to_numpy(dtype=float), rows["becomes"].to_numpy()
        change[:, 0] = np.isnan(was)
        for k in range(OTHER):
            change[:, k + 1] = (becomes == k).astype(np.int64) - (was == k)
        steps = counts + change.cumsum(axis=0)
        counts, upto = steps[-1], max(upto, int(rows["seq"].max()))
        # The end date is that of the first setting row after the last clearing one.
        effect = _statuses(steps, finished)
        cleared = np.flatnonzero(effect == _CLEARS)
        begin = cleared[-1] + 1 if len(cleared) else 0
        end = None if len(cleared) else end
        sets = np.flatnonzero(effect[begin:] == _SETS)
        if end is None and len(sets):
            end = rows["ts"].iloc[begin + sets[0]]
        stamp = None if end is None else int(end.value // 1000)
        state.update((*map(int, counts), stamp, upto))
        yield pd.DataFrame(
            [[key[0], *map(int, counts), end, upto]], columns=["project", *COUNTERS, "end_date", "seq"]
        ).astype({"end_date": "datetime64[ns]"})

    counters = ", ".join(f"{name} BIGINT" for name in COUNTERS)
    return deltas.groupBy("project").applyInPandasWithState(
        step,
        f"project STRING, {counters}, end_date TIMESTAMP, seq BIGINT",
        f"{counters}, end_us BIGINT, seq BIGINT",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def with_status(rollups: DataFrame, finished_as: str = "completed") -> DataFrame:
    """Counters as the project status of the batch roll-up."""
    n = F.col("n_samples")
    status = rollup_status(
        F.col("n_active") > 0, F.col("n_finished") == n, F.col("n_not_started") == n, finished_as
    )
    return rollups.withColumn("project_status", status)


DELTAS = "project STRING, seq BIGINT, ts TIMESTAMP, was INT, becomes INT"


def follow_rollup(
    log: DataFrame,
    project: str,
    sample: str,
    status: str,
    seq: str,
    ts: str,
    root: str,
    finished_as: str = "completed",
) -> None:
    """Work through all that the log has and keep it below ``root``; call again for more.

    Deltas are handed on through files with Spark's exactly-once file sink; every touched
    project is written to the ``projects`` folder once per batch.
    """
    spark = log.sparkSession
    deltas = sample_deltas(log, project, sample, status, seq, ts)
    (
        deltas.writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/deltas-checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/deltas")
        .awaitTermination()
    )
    handed_on = spark.readStream.schema(DELTAS).parquet(f"{root}/deltas")
    (
        project_rollups(handed_on, finished_as)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/projects-checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/projects")
        .awaitTermination()
    )


def rolled_up(spark: SparkSession, root: str, finished_as: str = "completed") -> DataFrame:
    """project, counters, end_date, project_status of every project as it is now."""
    # The state itself: one row per project, whatever was written before.
    state = spark.read.format("statestore").load(f"{root}/projects-checkpoint")
    columns = ", ".join(f"{name}: bigint" for name in [*COUNTERS, "end_us", "seq"])
    value = F.col("value.groupState").cast(f"struct<{columns}>")
    held = state.select(F.col("key.project").alias("project"), value.alias("held")).select("project", "held.*")
    return with_status(held, finished_as).select(
        "project", *COUNTERS, F.timestamp_micros("end_us").alias("end_date"), "project_status", "seq"
    )
