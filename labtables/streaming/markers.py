"""Streaming detector for complete marker sets."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labtables.operators.markers import marker_number

# The few Python functions that run in tasks travel with them, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Summary of a stretch as in ``labtables.operators.markers``: per marker that occurs,
#: where it first does, and what is seen (a bit per marker) and how often it fired at the
#: end, had it fired there.
Summary = dict[int, list[int]]


def summary_of(markers: np.ndarray, places: np.ndarray, n_markers: int) -> Summary:
    """Summary of one key's files of a stretch, in order.

    Steps from firing to firing, not from file to file: the next one is where the last of
    the markers occurs next.  The tails of all entries meet, so each is followed once.
    """
    if len(markers) == 1:
        return {int(markers[0]): [int(places[0]), 0, 0]}
    order = np.argsort(markers, kind="stable")
    present, begins = np.unique(markers[order], return_index=True)
    where = np.split(order, begins[1:])  # ascending positions of each marker
    known: dict[int, tuple[int, int]] = {}

    def follow(start: int) -> tuple[int, int]:
        """What is seen and how often it fired by the end, from nothing at ``start``."""
        path = []
        while start not in known:
            after = [at[np.searchsorted(at, start) :] for at in where]
            if len(present) < n_markers or any(not len(at) for at in after):
                seen = sum(1 << int(m) for m, at in zip(present, after, strict=True) if len(at))
                known[start] = (seen, 0)
                break
            path.append(start)
            start = max(int(at[0]) for at in after) + 1
        seen, fired = known[start]
        for place in reversed(path):
            fired += 1
            known[place] = (seen, fired)
        return seen, fired

    return {
        int(marker): [int(places[at[0]]), *follow(int(at[0]) + 1)]
        for marker, at in zip(present, where, strict=True)
    }


def chain(seen: int, summaries: Iterable[Summary], n_markers: int) -> tuple[int, int]:
    """State and number of firings after some stretches, from a given state."""
    total = 0
    for summary in summaries:
        new = [marker for marker in summary if not seen >> marker & 1]
        if seen.bit_count() + len(new) < n_markers:
            seen |= sum(1 << marker for marker in new)
        else:
            _, seen, fired = max(summary[marker] for marker in new)
            total += 1 + fired
    return seen, total


def written(summary: Summary) -> str:
    return ";".join(f"{m},{first},{seen:x},{fired}" for m, (first, seen, fired) in summary.items())


def read(text: str) -> Summary:
    parts = (entry.split(",") for entry in text.split(";"))
    return {int(m): [int(first), int(seen, 16), int(fired)] for m, first, seen, fired in parts}


def flowcell_ready(
    files: DataFrame,
    keys: list[str],
    file: str,
    required: list[str],
    seq: str,
    stretch_rows: int = 100_000,
    slices: int = 64,
) -> DataFrame:
    """Stream of (key.., n_events): how often a set was completed in a batch.

    Per key the state is the set of markers seen since the last event.  When all
    are there it fires and the state is removed, so a full second set fires
    again; it never expires.

    The rows of a batch are first reduced to one summary per key and stretch of
    the log; only summaries reach the task that owns the key's state.  A stream cannot
    aggregate before its state, so this reduction is numpy here and native in
    ``completions``.  Keys are dealt into ``slices``, and the state is one map per slice, of
    the keys with an incomplete set: handing over a state for each key costs milliseconds,
    and a batch touches many.  A slice should hold no more than some ten thousand
    incomplete keys; their number is fixed by the first batch.  Keys and summaries travel
    as short texts, as pandas would change large numbers beside nulls.
    """
    n_markers = len(set(required))
    key_ddl = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    marked = files.select(
        F.to_json(F.struct(*keys), exact).alias("_key"),
        F.expr(f"`{seq}` div {int(stretch_rows)}").alias("stretch"),
        F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int").alias("slice"),
        F.col(seq).cast("long").alias("_seq"),
        marker_number(file, required).alias("_marker"),
    ).where("_marker IS NOT NULL")

    def summarise(stretch: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes, keys_found = pd.factorize(rows["_key"])
        order = np.lexsort((rows["_seq"].to_numpy(), codes))
        codes = codes[order]
        markers, places = rows["_marker"].to_numpy()[order], rows["_seq"].to_numpy()[order]
        bounds = np.flatnonzero(np.diff(codes, prepend=-1, append=len(keys_found)))
        texts = [
            written(summary_of(markers[a:b], places[a:b], n_markers))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)
        ]
        return pd.DataFrame(
            {"slice": stretch[1], "_key": keys_found[codes[bounds[:-1]]], "stretch": stretch[0], "entries": texts}
        )

    summaries = marked.groupBy("stretch", "slice").applyInPandas(
        summarise, "slice INT, _key STRING, stretch BIGINT, entries STRING"
    )

    def track(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        arrived: dict[str, list[tuple[int, str]]] = {}
        for frame in frames:
            for name, stretch, text in zip(frame["_key"], frame["stretch"], frame["entries"], strict=True):
                arrived.setdefault(name, []).append((stretch, text))
        held: dict[str, str] = json.loads(state.get[0]) if state.exists else {}
        out: dict[str, int] = {}
        for name, stretches in arrived.items():
            before = int(held.pop(name, "0"), 16)
            parts = (read(text) for _, text in sorted(stretches))
            after, times = chain(before, parts, n_markers)
            if after:
                held[name] = f"{after:x}"
            if times:
                out[name] = times
        state.update((json.dumps(held),))
        yield pd.DataFrame({"_key": list(out), "n_events": list(out.values())})

    fired = summaries.groupBy("slice").applyInPandasWithState(
        track,
        "_key STRING, n_events BIGINT",
        "held STRING",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return fired.select(F.from_json("_key", key_ddl, exact).alias("_key"), "n_events").select(
        "_key.*", "n_events"
    )
