"""Nearest neighbours by an inverted multi-index.

Two halves of a vector are quantised separately (k-means on a bounded sample); a row's entry
is the pair of its nearest centroids.  A query walks centroid pairs best first, with a heap, by
the most that a row of the pair can score: both halves' inner products with the centroids, and
the half query's length times the farthest distance of a row from its centroid.  The walk ends
where that falls below the score of the query's top-th row in the sample, so no neighbour is
missed, at any number of rows; how much it leaves out depends on how well the rows cluster.
What is visited is ranked by the exact inner product of the original vectors in double
precision.

Every row is indexed.  Entries of one first centroid lie together in a bundle of up to BLOCK
rows; a larger entry is cut into blocks of about BLOCK rows, so that an entry with very many
rows (copies of one vector) is many tasks' work.  Each block gives its best rows for each query
that visits it, by one matrix product, and these are ranked once more.  Only the centroids, the
number of rows and the distances per entry (CENTROIDS squared at most) are gathered.

Defined cases: vectors that are null, empty, zero, of another than the usual length or with a
null or non-finite component take no part, neither as query nor as candidate; equal scores go to
the smaller vec_id; repeated vec_ids are candidates each, but never for a query of their own id;
with fewer candidates than asked for all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labtables.llm._common import letters_hash

CENTROIDS = 24
SAMPLE_ROWS = 16_384
KMEANS_ROUNDS = 12
BLOCK = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    numbers = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fine = numbers.where(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    return fine


def usual_length(vectors: DataFrame) -> int:
    """The length most vectors have; 0 for an empty table."""
    best = (
        vectors.groupBy(F.size("vector").alias("n"))
        .count()
        .orderBy(F.desc("count"), F.desc("n"))
        .limit(1)
        .collect()
    )
    return best[0][0] if best else 0


def sample_rows(vectors: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and vectors of some rows."""
    keep = min(1.0, SAMPLE_ROWS / max(rows, 1))
    place = F.pmod(letters_hash("vec_id"), F.lit(1 << 30))
    found = vectors.where(place < int(keep * (1 << 30))).limit(2 * SAMPLE_ROWS)
    some = found.select("vec_id", "vector").collect() or [vectors.select("vec_id", "vector").first()]
    return np.array([row[0] for row in some]), np.array([row[1] for row in some])


def kmeans(points: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    points = np.unique(points, axis=0)  # copies of one vector are one point
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(KMEANS_ROUNDS):
        near = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def walk(one: np.ndarray, two: np.ndarray, held: dict[int, int], least: float) -> list[int]:
    """Entries with rows by descending sum of both halves' bounds, as long as it reaches ``least``."""
    first, second = np.argsort(-one), np.argsort(-two)
    heap = [(-(one[first[0]] + two[second[0]]), 0, 0)]
    seen = {(0, 0)}
    out = []
    while heap and -heap[0][0] >= least:
        _, i, j = heapq.heappop(heap)
        entry = int(first[i]) * len(two) + int(second[j])
        if entry in held:
            out.append(entry)
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(one[first[a]] + two[second[b]]), a, b))
    return out


def bundles(held: dict[int, int], seconds: int) -> dict[int, int]:
    """The bundle of each entry: entries of one first centroid, together up to BLOCK rows."""
    out: dict[int, int] = {}
    size = 0
    last = -1
    for entry in sorted(held):
        if last < 0 or entry // seconds != last // seconds or size + held[entry] > BLOCK:
            last, size = entry, 0
        out[entry] = last
        size += held[entry]
    return out


def least_scores(
    asked: np.ndarray, points: np.ndarray, ids: np.ndarray, sample: np.ndarray, top: int
) -> np.ndarray:
    """What a row must score to be among a query's ``top``, as far as the sample tells."""
    out = np.full(len(asked), -np.inf)
    for start in range(0, len(asked) if len(sample) >= top else 0, 256):
        scores = points[start : start + 256] @ sample.T
        scores[asked[start : start + 256, None] == ids[None, :]] = -np.inf
        out[start : start + 256] = np.partition(scores, len(sample) - top, axis=1)[:, len(sample) - top]
    # Products of matrices and of vectors differ in their last digits.
    return out - 1e-9 * (1 + np.where(np.isfinite(out), np.abs(out), 0))


def search(vectors: DataFrame, is_query: Column, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest rows."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    fine = usable(vectors)
    length = usual_length(fine)
    if not length:
        return spark.createDataFrame([], result)
    fine = fine.where(F.size("vector") == length)
    rows = fine.count()
    ids, sample = sample_rows(fine, rows)
    middle = max(1, length // 2)
    left = kmeans(sample[:, :middle], CENTROIDS)
    right = kmeans(sample[:, middle:], CENTROIDS) if length > middle else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast((ids, sample))

    @F.pandas_udf("entry int, far_one double, far_two double")
    def entry_of(batch: pd.Series) -> pd.DataFrame:
        points = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, length))
        one = nearest_centre(points[:, :middle], left)
        two = nearest_centre(points[:, middle:], right)
        return pd.DataFrame(
            {
                "entry": (one * len(right) + two).astype(np.int32),
                "far_one": np.linalg.norm(points[:, :middle] - left[one], axis=1),
                "far_two": np.linalg.norm(points[:, middle:] - right[two], axis=1),
            }
        )

    indexed = fine.withColumn("at", entry_of("vector"))
    entries = (
        indexed.groupBy("at.entry")
        .agg(F.count(F.lit(1)), F.max("at.far_one"), F.max("at.far_two"))
        .collect()
    )
    held = {row[0]: row[1] for row in entries}
    far_left, far_right = np.zeros(len(left)), np.zeros(len(right))
    for entry, _, one, two in entries:
        far_left[entry // len(right)] = max(far_left[entry // len(right)], one)
        far_right[entry % len(right)] = max(far_right[entry % len(right)], two)
    bundle_of = bundles(held, len(right))
    sizes: dict[int, int] = {}
    for entry, n in held.items():
        sizes[bundle_of[entry]] = sizes.get(bundle_of[entry], 0) + n
    blocks = {bundle: -(-n // BLOCK) for bundle, n in sizes.items()}

    @F.pandas_udf("array<struct<bundle:int,block:int,least:double>>")
    def visits(asked: pd.Series, batch: pd.Series) -> pd.Series:
        points = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, length))
        ones, twos = points[:, :middle], points[:, middle:]
        most_one = ones @ left.T + np.linalg.norm(ones, axis=1)[:, None] * far_left
        most_two = twos @ right.T + np.linalg.norm(twos, axis=1)[:, None] * far_right
        least = least_scores(asked.to_numpy(), points, *shared.value, top)
        return pd.Series(
            [
                [
                    {"bundle": bundle, "block": block, "least": enough}
                    for bundle in dict.fromkeys(bundle_of[e] for e in walk(one, two, held, enough))
                    for block in range(blocks[bundle])
                ]
                for one, two, enough in zip(most_one, most_two, least, strict=True)
            ]
        )

    def looked_up(values: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    candidates = indexed.select(
        "vec_id", "vector", looked_up(bundle_of)[F.col("at.entry")].alias("bundle")
    ).withColumn("block", F.pmod(letters_hash("vec_id"), looked_up(blocks)[F.col("bundle")]).cast("int"))
    queries = (
        fine.where(is_query)
        .withColumn("visit", F.explode(visits("vec_id", "vector")))
        .select("vec_id", "vector", "visit.bundle", "visit.block", "visit.least")
    )

    def block(key: tuple, ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(have):
            have = have.sort_values("vec_id", kind="stable")
            ids, points = have["vec_id"].to_numpy(), np.stack(have["vector"].to_numpy())
            asked, least = ask["vec_id"].to_numpy(), ask["least"].to_numpy()
            for start in range(0, len(ask), 256):
                those = np.stack(ask["vector"].iloc[start : start + 256].to_numpy())
                rough = those @ points.T
                for row, query in enumerate(asked[start : start + 256]):
                    other = np.flatnonzero(ids != query)
                    if not len(other):
                        continue
                    values = rough[row][other]
                    k = min(top, len(other))
                    edge = np.partition(values, len(values) - k)[len(values) - k]
                    near = other[values >= max(edge - 1e-9 * (1 + abs(edge)), least[start + row])]
                    exact = exact_scores(those[row], points[near])
                    best = np.lexsort((ids[near], -exact))[:top]
                    out.append(
                        pd.DataFrame(
                            {"query_id": query, "vec_id": ids[near][best], "score": exact[best]}
                        )
                    )
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        return pd.concat(out)

    found = (
        queries.groupBy("bundle", "block")
        .cogroup(candidates.groupBy("bundle", "block"))
        .applyInPandas(block, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def exact_scores(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component so that equal vectors score equal."""
    return (points * query).cumsum(axis=1)[:, -1]
