"""Folders whose marker files have all arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.functions._cols import case_lookup, seen_words


def complete_folders(
    files: DataFrame, keys: list[str], file: str, required: list[str]
) -> DataFrame:
    """Keys for which every required file has been seen at least once."""
    return (
        files.where(F.col(file).isin(*required))
        .groupBy(*keys)
        .agg(F.size(seen_words(file, required)).alias("_seen"))
        .where(F.col("_seen") == len(set(required)))
        .select(*keys)
    )


# --------------------------------------------------------------------------
# Counting completions.
#
# A folder collects markers until it has them all, fires once, and starts over.
# Whatever it had before a stretch of its file log, it can fire first in that
# stretch only where some marker occurs for the first time: where the last of
# the missing ones does.  After that it starts from nothing, so the rest of the
# stretch is the same for every start.  A stretch is therefore fully described
# by one entry per marker that occurs in it: where it first does, and, had the
# folder fired there, what it has seen and how often it fired by the end.  Such
# summaries are chained in order, and two neighbours make one summary of the
# same form.  That lets the log of one very busy folder be worked on in many
# tasks, and chained in levels.
# --------------------------------------------------------------------------

#: One entry of a summary; a marker is its number among the required ones.
ENTRY = "STRUCT<marker: INT, first: BIGINT, seen: ARRAY<INT>, fired: BIGINT>"


def marker_number(file: str, required: list[str]) -> Column:
    """Number of a required file; null for any other, and for a name given again."""
    numbers = {name: F.lit(i) for i, name in enumerate(dict.fromkeys(required))}
    return case_lookup(file, numbers, F.lit(None).cast("int"))


def _state(seen: Column, fired: Column) -> Column:
    return F.struct(seen.alias("seen"), fired.alias("fired"))


def _start() -> Column:
    return _state(F.array().cast("array<int>"), F.lit(0).cast("long"))


def _entry(marker: Column, first: Column, state: Column) -> Column:
    return F.struct(
        marker.alias("marker"),
        first.alias("first"),
        state["seen"].alias("seen"),
        state["fired"].alias("fired"),
    )


def _watch(markers: Column, n_markers: int) -> Column:
    """What is seen and how often it fired after some files, from nothing."""

    def step(state: Column, marker: Column) -> Column:
        seen, fired = state["seen"], state["fired"]
        return (
            F.when(F.array_contains(seen, marker), state)
            .when(F.size(seen) == n_markers - 1, _state(F.array().cast("array<int>"), fired + 1))
            .otherwise(_state(F.concat(seen, F.array(marker)), fired))
        )

    return F.aggregate(markers, _start(), step)


def _after(state: Column, entries: Column, n_markers: int) -> Column:
    """State after a summarised stretch, from the state before it."""
    new = F.filter(entries, lambda e: ~F.array_contains(state["seen"], e["marker"]))
    last = F.array_max(F.transform(new, lambda e: F.struct(e["first"], e["seen"], e["fired"])))
    return F.when(
        F.size(state["seen"]) + F.size(new) == n_markers,
        _state(last["seen"], state["fired"] + 1 + last["fired"]),
    ).otherwise(
        _state(F.concat(state["seen"], F.transform(new, lambda e: e["marker"])), state["fired"])
    )


def _joined(left: Column, right: Column, n_markers: int) -> Column:
    """Summary of two neighbouring stretches."""
    known = F.transform(left, lambda e: e["marker"])
    moved = F.transform(
        left,
        lambda e: _entry(
            e["marker"], e["first"], _after(_state(e["seen"], e["fired"]), right, n_markers)
        ),
    )
    return F.concat(moved, F.filter(right, lambda e: ~F.array_contains(known, e["marker"])))


def stretch_summaries(
    files: DataFrame,
    keys: list[str],
    file: str,
    required: list[str],
    seq: str,
    stretch_rows: int = 100_000,
) -> DataFrame:
    """Summary of each stretch of each key's log: (keys.., stretch, entries).

    ``seq`` is a unique number that orders the log.  A stretch is ``stretch_rows``
    numbers of it, so the list gathered for one holds no more rows than that.
    """
    n_markers = len(set(required))
    stretches = (
        files.select(
            *keys,
            F.expr(f"`{seq}` div {int(stretch_rows)}").alias("stretch"),
            F.struct(
                F.col(seq).cast("long").alias("seq"), marker_number(file, required).alias("marker")
            ).alias("_file"),
        )
        .where("_file.marker IS NOT NULL")
        .groupBy(*keys, "stretch")
        .agg(F.array_sort(F.collect_list("_file")).alias("_files"))
        .withColumn("_markers", F.col("_files.marker"))
    )

    def entry(marker: Column) -> Column:
        place = F.array_position("_markers", marker).cast("int")
        rest = F.slice("_markers", place + 1, F.size("_markers"))
        first = F.get("_files", place - 1)["seq"]
        return _entry(marker, first, _watch(rest, n_markers))

    entries = F.transform(F.array_distinct("_markers"), entry)
    return stretches.select(*keys, "stretch", entries.cast(f"ARRAY<{ENTRY}>").alias("entries"))


def merge_stretches(
    summaries: DataFrame, keys: list[str], n_markers: int, fan_in: int = 1000
) -> DataFrame:
    """Up to ``fan_in`` neighbouring stretches of a key made one."""
    in_order = F.array_sort(F.collect_list(F.struct("stretch", "entries")))
    gathered = summaries.groupBy(*keys, F.expr(f"stretch div {int(fan_in)}").alias("_wider")).agg(
        in_order.alias("_parts")
    )
    entries = F.aggregate(
        "_parts",
        F.array().cast(f"ARRAY<{ENTRY}>"),
        lambda left, part: _joined(left, part["entries"], n_markers).cast(f"ARRAY<{ENTRY}>"),
    )
    return gathered.select(*keys, F.col("_wider").alias("stretch"), entries.alias("entries"))


def completions(
    files: DataFrame,
    keys: list[str],
    file: str,
    required: list[str],
    seq: str,
    stretch_rows: int = 100_000,
    levels: int = 1,
    fan_in: int = 1000,
) -> DataFrame:
    """How often each key's marker set was completed, in log order.

    Batch form of the stream in ``labtables.streaming.markers``.  Every level joins
    ``fan_in`` neighbouring stretches into one, in tasks of their own, before a key
    brings together what is left: at the defaults 1,000 summaries for a log of
    10^11 numbers.  Add a level for every factor of 1,000 beyond.
    """
    n_markers = len(set(required))
    summaries = stretch_summaries(files, keys, file, required, seq, stretch_rows)
    for _ in range(levels):
        summaries = merge_stretches(summaries, keys, n_markers, fan_in)
    in_order = F.array_sort(F.collect_list(F.struct("stretch", "entries")))
    total = F.aggregate(
        "_stretches",
        _start(),
        lambda state, part: _after(state, part["entries"], n_markers),
    )
    return (
        summaries.groupBy(*keys)
        .agg(in_order.alias("_stretches"))
        .select(*keys, total["fired"].alias("n_events"))
        .where("n_events > 0")
    )
