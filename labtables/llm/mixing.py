"""Mixing sources to target weights by proportionate fair (Pfair) scheduling.

Each source's documents are dealt by a hash into buckets and from these into blocks.  Block j
(from 0) of a source of weight w (its share of all weights, exactly as given) has release time
floor(j / w) and deadline ceil((j + 1) / w); at each time slot the released block with the
earliest deadline runs.  As long as no source has run out, every source has had its weight's
share of the slots to within less than one block, at every time of the whole run.

A block has BLOCK_CHARS characters, or as many more as it takes for the tables to have at most
MOST_BLOCKS blocks and one for each source: the schedule of whole blocks is worked out on the
driver, from a row per source, and never grows beyond that.  Buckets look up the slots of their
blocks by an equi-join, documents those of their bucket: texts are dealt out once.

All documents are kept.  A source that has no blocks left leaves its slots empty, so the
others keep their pace relative to each other; a document longer than a block takes the
slots of several (the blocks after its first stay empty).

No source is gathered in one task, however large: running totals are taken inside buckets of
about BUCKET_ROWS documents and over the buckets' sums.

Defined cases: a null source is a source of its own; a null or empty text has length 0 (it
counts 1); repeated rows are kept, each, in blocks side by side; a very long text is one document
and is not cut; an empty table gives no rows; weights of sources that the table lacks are ignored;
sources without a weight above zero get the smallest one (1 if there is none), and weights below
LEAST_WEIGHT of the largest count as that; of blocks with the same deadline the one released first
runs, then the one of the source that is first in order.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labtables.llm._common import letters_hash
from labtables.sources.dimensions import dimension

BLOCK_CHARS = 1 << 16
MOST_BLOCKS = 1 << 20
BUCKET_ROWS = 4096
LEAST_WEIGHT = 2.0**-20


def block_chars(total: float) -> int:
    """Characters of a block, where all texts together have ``total``."""
    return max(BLOCK_CHARS, -(-int(total) // MOST_BLOCKS))


def usable_weights(
    weights: dict[str | None, float], names: list[str | None]
) -> dict[str | None, float]:
    """A weight above zero for each of the names."""
    given = {n: float(weights[n]) for n in names if weights.get(n) is not None and weights[n] > 0}
    if not given:
        return dict.fromkeys(names, 1.0)
    smallest, largest = min(given.values()), max(given.values())
    return {n: max(given.get(n, smallest), largest * LEAST_WEIGHT) for n in names}


def schedule(
    weights: dict[str | None, float], blocks: dict[str | None, int]
) -> list[tuple[str | None, int, int]]:
    """(source, block, slot) of all blocks by earliest deadline first, in the order of slots."""
    names = sorted((n for n in blocks if blocks[n] > 0), key=lambda n: (n is None, n))
    exact = [Fraction(weights[n]) for n in names]
    # Weights as whole numbers: windows are exact, however long the run.
    scale = max((w.denominator for w in exact), default=1)  # powers of two
    whole = [int(w * scale) for w in exact]
    total = sum(whole)
    waiting = [(0, k, 0) for k in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []  # deadline, release, source, block
    out = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // whole[k]), release, k, j))
        _, _, k, j = heapq.heappop(ready)
        out.append((names[k], j, slot))
        if j + 1 < blocks[names[k]]:
            heapq.heappush(waiting, ((j + 1) * total // whole[k], k, j + 1))
        slot += 1
    return out


def tempered(sizes: dict[str | None, float], power: float = 0.5) -> dict[str | None, float]:
    """Target weights that lift small sources: sizes to a power."""
    return {name: max(size, 1) ** power for name, size in sizes.items()}


def source_sizes(docs: DataFrame, size: Column | None = None) -> dict[str | None, float]:
    """Characters of each source, a row per source."""
    size = document_size() if size is None else size
    rows = docs.groupBy("source").agg(F.sum(size).alias("size")).collect()
    return {row["source"]: float(row["size"]) for row in rows}


def _key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def document_size() -> Column:
    """Characters of a document, at least 1."""
    return F.greatest(F.coalesce(F.char_length("text"), F.lit(0)), F.lit(1)).cast("long")


def document_key() -> Column:
    """What deals documents to buckets; whole copies of a row are interchangeable."""
    return letters_hash("doc_id", "text")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float],
    size: Column | None = None,
    key: Column | None = None,
) -> DataFrame:
    """All columns and rows of ``docs`` and __mix: block, slot, place (order inside the block).

    Sorting by __mix.slot, __mix.place gives the mixed order.  Where ``docs`` has no texts,
    ``size`` and ``key`` say what ``document_size()`` and ``document_key()`` said of them; slots
    are the same then.
    """
    size = document_size() if size is None else size
    key = document_key() if key is None else key
    spark = docs.sparkSession
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
        F.col("source"),
        _key().alias("key"),
        size.alias("size"),
        # Copies of a document go to different buckets only by doc_id.
        key.alias("place"),
    )
    sums = docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum(size).alias("size")).collect()
    if not sums:
        return docs.withColumn("__mix", F.lit(None).cast("struct<block:long,slot:long,place:long>"))
    block = block_chars(sum(r["size"] for r in sums))
    slots = schedule(
        usable_weights(weights, [r["source"] for r in sums]),
        {r["source"]: -(-r["size"] // block) for r in sums},
    )
    buckets = _lookup({r["source"]: -(-r["rows"] // BUCKET_ROWS) for r in sums})
    keyed = keyed.withColumn("bucket", F.pmod(F.col("place"), buckets))

    # Characters before each bucket of a source, from one row per bucket.
    order = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    light = docs.select("source", _key().alias("key"), size.alias("size"), key.alias("place"))
    before = (
        light.withColumn("bucket", F.pmod(F.col("place"), buckets))
        .groupBy("key", "bucket")
        .agg(F.sum("size").alias("size"))
        .select("key", "bucket", "size", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"))
    )
    table = dimension(
        spark,
        "key string, block long, slot long",
        [("" if s is None else f"={s}", j, slot) for s, j, slot in slots],
    )
    # A bucket covers a run of blocks; their slots go to its one row, so that documents are
    # dealt by bucket once and need no second join.
    first, last = (F.floor(at / block).cast("long") for at in (F.col("before"), F.expr("before + size - 1")))
    slots_of = (
        before.select("key", "bucket", "before", F.explode(F.sequence(first, last)).alias("block"))
        .join(table, ["key", "block"])
        .groupBy("key", "bucket")
        .agg(
            F.min("before").alias("before"),
            F.min("block").alias("first"),
            F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("slots"),
        )
    )
    inside = (
        Window.partitionBy("key", "bucket")
        .orderBy("place", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(slots_of, ["key", "bucket"])
        .withColumn("at", F.col("within") + F.col("before"))
        .withColumn("block", F.floor(F.col("at") / block).cast("long"))
        .withColumn("slot", F.get("slots", (F.col("block") - F.col("first")).cast("int")))
    )
    return placed.select(
        *[F.col("row")[n].alias(n) for n in names],
        F.struct("block", "slot", F.col("at").cast("long").alias("place")).alias("__mix"),
    )


def _lookup(values: dict[str | None, int]) -> Column:
    """The value of the row's source, one entry per source."""
    known = [F.lit(x) for name, value in values.items() if name is not None for x in (name, value)]
    missing = F.lit(values.get(None, 1))
    if not known:
        return missing
    return F.coalesce(F.create_map(*known)[F.col("source")], missing)
