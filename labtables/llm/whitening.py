"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

A vector's entries c become whole numbers floor(1024 c) + 100000, whose sums are exact.  With the
rows less their means as a matrix X, the method walks v -> X v -> X^T u -> v and so on: the lengths
met are a small bidiagonal matrix B = U^T X V, whose singular value decomposition gives the
components (directions in V) and deviations (singular values).

The long vectors u are never stored: each is X w for a known short w, so one pass over the rows
gives, for a new v, the length of what X v adds to the earlier u, its products with all of them
(full reorthogonalisation: the part that rounding left in their direction is taken off again) and
X^T of it.  Each pass adds numbers per column and per step on Spark; the driver holds vectors of
the dimension and the small matrix only.  The new v is reorthogonalised against all earlier ones.

The walk ends when the residuals of the wanted components are below rounding and one more walk,
from a fresh direction orthogonal to all before, has settled too (a single walk meets only one
direction of those with equal deviation), or when all dimensions are used up.

Rows are packed once into blocks of whole numbers, written to the shared folder; a pass reads
them as matrices.

Defined cases: vectors that are null or have null or non-finite entries, or entries of 2^40 or
more, take no part, nor do those of another than the most frequent length (the longer one of a
tie); a null vec_id is kept; repeated rows count each; components without any deviation are left
out, so fewer rows than asked for, copies of one vector and a single row give fewer or none; a
row's exact deviation beyond a long is null; vectors of any length are worked on whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.session import scratch_dir

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Rows of a packed block.
BLOCK_ROWS = 2048
#: Residuals and lengths below this share of the largest deviation count as rounding.
ROUNDING = 1e-14


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x (array of long) of the rows that take part."""
    entries = F.col(vector).cast("array<double>")
    fine = vectors.select(F.col(key).alias("id"), entries.alias("c")).where(
        F.col("c").isNotNull()
        & (F.size("c") > 0)
        & F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 40)))
    )
    usual = (
        fine.groupBy(F.size("c").alias("n"))
        .count()
        .orderBy(F.desc("count"), F.desc("n"))
        .limit(1)
        .collect()
    )
    width = usual[0][0] if usual else 0
    x = F.transform("c", lambda c: F.floor(c * SCALE) + SHIFT)
    return fine.where(F.size("c") == width).select("id", x.alias("x"))


class Rows:
    """The rows in packed blocks, and passes over them."""

    def __init__(self, numbers: DataFrame):
        spark = numbers.sparkSession
        self.id_type = numbers.schema["id"].dataType.simpleString()
        folder = scratch_dir(spark, "vectors")
        packed = f"ids array<{self.id_type}>, x binary, rows int"
        numbers.mapInArrow(_pack, packed).write.parquet(folder)
        self.blocks = spark.read.parquet(folder)
        # Two halves of each number, so that sums of very many or very large ones stay exact.
        sums = self.total(
            lambda x: np.concatenate(([len(x)], (x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0))),
            whole=True,
        )
        self.n = int(sums[0]) if len(sums) else 0
        width = len(sums) // 2
        self.sums = [(int(a) << 24) + int(b) for a, b in zip(sums[1 : width + 1], sums[width + 1 :], strict=True)]
        self.means = np.array([s / self.n for s in self.sums])

    def total(self, part: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray:
        """Sum over all blocks of what ``part`` makes of a block's rows."""
        kind = "long" if whole else "double"

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for _, x in _matrices(batches):
                found = part(x)
                sums = found if sums is None else sums + found
            if sums is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["place", "value"]
                )

        added = (
            self.blocks.select("x", "rows")
            .mapInArrow(add, f"place int, value {kind}")
            .groupBy("place")
            .agg(F.sum("value").alias("value"))
            .collect()
        )
        out = np.zeros(len(added), dtype=np.int64 if whole else np.float64)
        for place, value in added:
            out[place] = value
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), BLOCK_ROWS):
            some = batch.slice(start, BLOCK_ROWS)
            ids = some.column(0)
            offsets = pa.array([0, len(some)], pa.int32())
            x = some.column(1).flatten().to_numpy().astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(offsets, ids),
                    pa.array([x], pa.binary()),
                    pa.array([len(some)], pa.int32()),
                ],
                ["ids", "x", "rows"],
            )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array | None, np.ndarray]]:
    for batch in batches:
        has_ids = "ids" in batch.schema.names
        for k, (x, rows) in enumerate(zip(batch["x"], batch["rows"], strict=True)):
            matrix = np.frombuffer(x.as_buffer(), dtype="<i8").reshape(rows.as_py(), -1)
            yield (batch["ids"][k].values if has_ids else None), matrix


class Bidiagonal:
    """The state of the walk: rows of ``v``, ``w`` (u = X w) and ``g`` (X^T u), and B."""

    def __init__(self, rows: Rows, wanted: int, seed: int = 11):
        self.rows, self.wanted = rows, wanted
        self.d = len(rows.means)
        self.random = np.random.default_rng(seed)
        self.v, self.w, self.g = (np.zeros((0, self.d)) for _ in range(3))
        self.b = np.zeros((0, 0))
        self.largest = 0.0

    def fresh(self) -> np.ndarray | None:
        """A unit direction orthogonal to all so far."""
        if len(self.v) == self.d:
            return None
        return self.outside(self.random.standard_normal(self.d))[0]

    def outside(self, p: np.ndarray) -> tuple[np.ndarray, float]:
        """The part of p that is orthogonal to all v, as a unit vector, and its length."""
        for _ in range(2):
            p = p - self.v.T @ (self.v @ p)
        length = float(np.linalg.norm(p))
        if length == 0.0:
            return p, 0.0
        p = p / length
        p = p - self.v.T @ (self.v @ p)
        return p / np.linalg.norm(p), length

    def step(self, v: np.ndarray) -> tuple[np.ndarray, float] | None:
        """Add v and the u it leads to; the next v and its length, or None where the walk ends."""
        along = self.g @ v  # U^T X v
        w = v - self.w.T @ along
        means, known = self.rows.means, self.w

        def products(x: np.ndarray) -> np.ndarray:
            centred = x - means
            r = centred @ w
            u = centred @ known.T
            return np.concatenate(([r @ r], r @ u, r @ centred))

        while True:
            found = self.rows.total(products)
            square, rest, back = found[0], found[1 : 1 + len(known)], found[1 + len(known) :]
            along = along + rest
            w = w - known.T @ rest
            # Taken off once more only if rounding had left much in the direction of earlier u.
            if rest @ rest <= 1e-4 * square or square <= (ROUNDING * self.largest) ** 2:
                break
        length = float(np.sqrt(max(square - rest @ rest, 0.0)))
        back = back - self.g.T @ rest
        self.v = np.vstack([self.v, v])
        b = np.zeros((len(self.w) + 1, len(self.v)))
        b[: self.b.shape[0], : self.b.shape[1]] = self.b
        b[:-1, -1] = along
        if length <= ROUNDING * max(self.largest, length):
            self.b = b[:-1]
            return None
        b[-1, -1] = length
        self.b = b
        self.w = np.vstack([self.w, w / length])
        self.g = np.vstack([self.g, back / length])
        self.largest = max(self.largest, float(np.linalg.norm(b[:, -1])))
        return self.outside(self.g[-1])

    def settled(self, beyond: float, begun: tuple[int, int]) -> bool:
        """Are the wanted singular values, and the largest of the walk begun last, beyond change?

        ``begun``: how many u and v there were when the last walk began.
        """
        left, values, _ = np.linalg.svd(self.b)
        last = beyond * np.abs(left[-1, : len(values)])
        enough = last <= ROUNDING * values[0]
        if len(values) < self.wanted or not enough[: self.wanted].all():
            return False
        if begun[1]:  # a later walk: its own largest value, in its own rows and columns
            own_left, own, _ = np.linalg.svd(self.b[begun[0] :, begun[1] :])
            return bool(beyond * abs(own_left[-1, 0]) <= 1e-6 * own[0] or own[0] <= ROUNDING * values[0])
        return True

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Unit components (rows) and singular values, falling."""
        v, begun, walks = self.fresh(), (0, 0), 0
        while v is not None:
            following = self.step(v)
            ends = following is None or following[1] <= ROUNDING * self.largest
            if not ends and not self.settled(following[1], begun):
                v = following[0] if len(self.v) < self.d else None
                continue
            if not ends:
                walks += 1
                if walks == 2:
                    break
            begun, v = (len(self.w), len(self.v)), self.fresh()
        if not self.b.size:
            return np.zeros((0, self.d)), np.zeros(0)
        _, values, right = np.linalg.svd(self.b, full_matrices=False)
        fine = values > 1e-7 * values[0] if len(values) and values[0] > 0 else np.zeros(0, dtype=bool)
        values, right = values[: len(fine)][fine], right[: len(fine)][fine]
        components = right[: self.wanted] @ self.v
        components /= np.linalg.norm(components, axis=1, keepdims=True)
        return components, values[: self.wanted]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over a row's entries of (n x - sum)^2, exactly; null where that is beyond a long."""
    largest = max(n * int(np.abs(x).max(initial=0)), *(abs(s) for s in sums))
    if largest < 1 << 61:
        far = n * x - np.array(sums, dtype=np.int64)
        if (float(np.abs(far).max(initial=0)) + 1) ** 2 * x.shape[1] < 2.0**62:
            return pa.array((far**2).sum(axis=1))
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([value if value < 1 << 63 else None for value in exact], pa.int64())


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of every row."""
    spark = vectors.sparkSession
    rows = Rows(whole_numbers(vectors, key, vector))
    schema = (
        f"`{key}` {rows.id_type}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if not rows.n:
        return spark.createDataFrame([], schema)
    n, sums, means = rows.n, rows.sums, rows.means
    directions, values = Bidiagonal(rows, components).run()
    if not len(values):
        return spark.createDataFrame([], schema)
    trace = float(rows.total(lambda x: np.array([((x - means) ** 2).sum()]))[0]) / n
    shares = values**2 / n / trace
    to_white = directions / (values / np.sqrt(n))[:, None]
    k = len(values)

    def white(x: np.ndarray) -> np.ndarray:
        return (x - means) @ to_white.T

    middle = rows.total(lambda x: white(x).sum(axis=0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = white(x) - middle
        return (centred.T @ centred).ravel()

    covariance = rows.total(products).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            squares = deviations(x, n, sums)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(x) * k, n), pa.int64()),
                    squares.take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(white(x).ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.blocks.mapInArrow(out, schema)
