"""Best-fit packing of token pieces into sequences, by linear grouping.

A document longer than a sequence is cut into whole sequences, its remainder first; no
other document is cut.  Pieces are dealt by a hash to shards of about SHARD_PIECES and a
shard is packed by one task from lengths alone (a few MB).  In a shard:

1. large pieces (over CAPACITY / 8) are sorted and dealt to groups of equal cardinality; each
   counts as long as the longest of its group;
2. how often to use which configuration of these few sizes is a linear programme over
   configurations, solved by column generation (a knapsack prices new ones) to less than one
   sequence from its best, and rounded down;
3. pieces themselves take the places: the longest left that the place's size allows, and in
   a configuration's last place the longest that the room allows, as the pieces before it
   are shorter than they counted;
4. the rest, largest first, goes where it fits best, small pieces last, and into new
   sequences where nothing has room;
5. where best fit of all pieces alone needs fewer sequences, as it can where rounding lengths
   up costs more than configurations save, that packing is taken.

In a given order (``packed_in_order``) shards are ranges of it, packed in runs of RUN_PIECES, and
sequences are numbered by the middle place of their pieces, so that what is read first comes first.

Defined cases: a null text is the empty text, of one id; repeated rows are packed each; a very
long text is cut into pieces and nothing of it but their lengths and sums is kept; pieces of one
length are interchangeable, and which takes which place is not fixed; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.llm import mixing
from labtables.llm._common import give_back, texts
from labtables.llm._tokens import encoder
from labtables.session import scratch_dir

CAPACITY = 2048
SHARD_PIECES = 200_000
#: Pieces that are packed together where an order is to be kept.
RUN_PIECES = 8192
GROUPS = 96

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document, without its ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encoder(vocabulary).encode(batch["text"]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = [0, *range(first, len(ids) + 1, capacity)]
                doc = None if pd.isna(doc) else int(doc)
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})
            give_back()

    return texts(docs).mapInPandas(cut, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``cut`` is read twice, so pass a written table."""
    shards = max(1, -(-cut.count() // SHARD_PIECES))
    names = cut.columns

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["shard"].iloc[0])
        sequence, offset = pack_lengths(group["length"].to_numpy(), capacity)
        return group[names].assign(sequence_id=sequence + (number << 32), offset=offset)

    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))
    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return cut.withColumn("shard", key).groupBy("shard").applyInPandas(shard, schema)


def pack_in_order(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with slot and place, in whose order they are packed;
    ``cut`` is read several times, so pass a written table."""
    shards = max(1, -(-cut.count() // SHARD_PIECES))
    names = cut.columns
    # Slots hold few pieces each, so ranges of them are about even.
    cuts = sorted(set(cut.approxQuantile("slot", [k / shards for k in range(1, shards)], 0.1 / shards))) if shards > 1 else []
    number = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(int(c)) for c in cuts])
        number = F.size(F.filter(edges, lambda edge: edge < F.col("slot")))

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slot", "place", "doc_id", "ids_crc32", "piece"], kind="stable")
        first = int(group["shard"].iloc[0]) << 32
        parts = []
        for start in range(0, len(group), RUN_PIECES):
            run = group.iloc[start : start + RUN_PIECES]
            sequence, offset = pack_lengths(run["length"].to_numpy(), capacity)
            middle = pd.Series(np.arange(len(run))).groupby(sequence).median().sort_values(kind="stable")
            rank = np.empty(int(sequence.max()) + 1, dtype=np.int64)
            rank[middle.index.to_numpy()] = np.arange(len(middle))
            parts.append(run[names].assign(sequence_id=first + rank[sequence], offset=offset))
            first += len(middle)
        return pd.concat(parts)

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return cut.withColumn("shard", number).groupBy("shard").applyInPandas(shard, schema)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and place of each length (1 to capacity).

    Whichever is fewer sequences: the configurations' or those of best fit alone.
    """
    order = np.argsort(-lengths, kind="stable")
    planned = _Open(lengths, capacity)
    planned.configure(order[lengths[order] > capacity // 8])
    planned.best_fit(order)
    plain = _Open(lengths, capacity)
    plain.best_fit(order)
    fewer = planned if len(planned.room) <= len(plain.room) else plain
    return fewer.sequence, fewer.offset


class _Open:
    """Sequences that are being filled, by their room."""

    def __init__(self, lengths: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.sequence = np.full(len(lengths), -1, dtype=np.int64)
        self.offset = np.zeros(len(lengths), dtype=np.int64)
        self.room: list[int] = []

    def put(self, i: int, at: int) -> None:
        self.sequence[i] = at
        self.offset[i] = self.capacity - self.room[at]
        self.room[at] -= int(self.lengths[i])

    def configure(self, large: np.ndarray) -> None:
        """Large pieces, given by falling length, take the places of configurations."""
        if not len(large):
            return
        lengths, capacity = self.lengths, self.capacity
        sizes, demand = rounded_sizes(lengths[large])
        # Pieces left of each length, and a bit for each length that is left.
        left: list[list[int]] = [[] for _ in range(capacity + 1)]
        lengths_left = 0
        for i in large:
            left[lengths[i]].append(i)
            lengths_left |= 1 << int(lengths[i])

        def take(at_most: int) -> int | None:
            """The longest piece left of at most this length."""
            nonlocal lengths_left
            fitting = lengths_left & ((1 << (at_most + 1)) - 1)
            if not fitting:
                return None
            length = fitting.bit_length() - 1
            i = left[length].pop()
            if not left[length]:
                lengths_left ^= 1 << length
            return i

        room = self.room
        for configuration, times in configurations(sizes, demand, capacity):
            for _ in range(times):
                room.append(capacity)
                for place, k in enumerate(configuration):
                    last = place == len(configuration) - 1
                    i = take(room[-1] if last else min(room[-1], int(sizes[k])))
                    if i is not None:
                        self.put(i, len(room) - 1)
                if room[-1] == capacity:
                    room.pop()

    def best_fit(self, order: np.ndarray) -> None:
        """Pieces without a place, by falling length, go where they leave the least room."""
        # Open sequences by their room, and a bit for each room that occurs.
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0
        for at, space in enumerate(self.room):
            by_room[space].append(at)
            rooms |= 1 << space
        for i in order[self.sequence[order] < 0]:
            need = int(self.lengths[i])
            fitting = rooms >> need
            if fitting:
                space = need + (fitting & -fitting).bit_length() - 1
                at = by_room[space].pop()
                if not by_room[space]:
                    rooms ^= 1 << space
            else:
                at = len(self.room)
                self.room.append(self.capacity)
            self.put(i, at)
            by_room[self.room[at]].append(at)
            rooms |= 1 << self.room[at]


def rounded_sizes(falling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few sizes and how many lengths count as each: lengths are rounded up to the longest of
    their group, and groups of the same longest are one size.  Few different lengths stay exact."""
    sizes, demand = np.unique(falling, return_counts=True)
    if len(sizes) > GROUPS:
        groups = np.array_split(falling, GROUPS)
        longest = np.array([g[0] for g in groups])
        sizes, size_of = np.unique(longest, return_inverse=True)
        demand = np.bincount(size_of, weights=[len(g) for g in groups]).astype(np.int64)
    return sizes, demand


def configurations(
    sizes: np.ndarray, demand: np.ndarray, capacity: int
) -> Iterator[tuple[list[int], int]]:
    """(configuration as group numbers, how often), never more places than pieces.

    New configurations are asked for until the solution is less than one sequence from the best
    (its total over the dearest configuration's price bounds the best from below).
    """
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    need = demand.astype(float)
    # Amounts that differ a little never tie, so every new configuration lowers the total.
    apart = need + np.arange(1, k + 1) * 1e-5 / k
    lowest, since = np.inf, 0
    while True:
        prices = np.linalg.solve(columns.T, np.ones(k))
        value, column = best_configuration(sizes, prices, capacity)
        total = float(prices @ apart)
        # A total that no longer falls has met the precision of doubles.
        lowest, since = (total, 0) if total < lowest else (lowest, since + 1)
        if value <= 1 + 1e-6 or total - total / value < 1 or since > 8 * k:
            break
        used = np.linalg.solve(columns, apart)
        change = np.linalg.solve(columns, column)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        columns[:, int(ratio.argmin())] = column
    used = np.linalg.solve(columns, need)
    for j in np.argsort(-used):
        times = int(np.floor(used[j] + 1e-6))
        if times > 0:
            places = columns[:, j].round().astype(int)
            yield [g for g in reversed(range(k)) for _ in range(places[g])], times


def best_configuration(
    sizes: np.ndarray, prices: np.ndarray, capacity: int
) -> tuple[float, np.ndarray]:
    """The configuration worth most, by dynamic programming over the space it fills.

    Spaces are worked out as many at once as the smallest size is long, as each needs only
    spaces that are smaller by a size.
    """
    useful = np.flatnonzero(prices > 1e-9)
    worth = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    if len(useful):
        long, price = sizes[useful], prices[useful]
        step = int(long.min())
        for start in range(step, capacity + 1, step):
            space = np.arange(start, min(start + step, capacity + 1))
            before = space[:, None] - long
            values = np.where(before >= 0, worth[np.maximum(before, 0)] + price, -1.0)
            best = values.argmax(axis=1)
            value = values[np.arange(len(space)), best]
            grown = np.maximum.accumulate(np.append(worth[start - 1], value))
            better = value > grown[:-1] + 1e-12
            worth[space] = grown[1:]
            last[space[better]] = useful[best[better]]
    column, space = np.zeros(len(sizes)), capacity
    while space > 0:
        if last[space] < 0:
            space -= 1
        else:
            column[last[space]] += 1
            space -= int(sizes[last[space]])
    return float(worth[capacity]), column


def packed(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document and their places; lengths are written once in between."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "pieces")
    pieces(docs, vocabulary, end_id, capacity).write.parquet(folder)
    return pack(spark.read.parquet(folder), capacity)


def document_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY
) -> DataFrame:
    """One row per document with its pieces and, for ``mixing.mix``, its source, size and key."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = []
            for ids in encoder(vocabulary).encode(batch["text"]):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                at = [0, *range(first, len(ids) + 1, capacity)]
                every.append(
                    [
                        {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())}
                        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))
                    ]
                )
            yield batch.drop(columns="text").astype({"doc_id": "Int64"}).assign(pieces=every)
            give_back()

    kept = docs.select(
        "doc_id",
        "source",
        mixing.document_size().alias("size"),
        mixing.document_key().alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    pieces_type = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
    return kept.mapInPandas(cut, f"doc_id long, source string, size long, key long, pieces {pieces_type}")


def packed_in_order(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of every document and their places, with source and slot, in the order that mixes
    the sources to the root of their sizes; sequences are numbered in that order."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "mixed")
    document_pieces(docs, vocabulary, end_id, capacity).write.parquet(f"{folder}-documents")
    held = spark.read.parquet(f"{folder}-documents")
    size, key = F.col("size"), F.col("key")
    mixed = mixing.mix(held, mixing.tempered(mixing.source_sizes(held, size)), size, key)
    mixed.select(
        "doc_id", "source", "__mix.slot", "__mix.place", F.explode("pieces").alias("cut")
    ).select("doc_id", "cut.*", "source", "slot", "place").write.parquet(f"{folder}-pieces")
    return pack_in_order(spark.read.parquet(f"{folder}-pieces"), capacity).drop("place")
