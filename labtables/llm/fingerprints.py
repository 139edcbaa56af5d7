"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for one text, the running sums of code point times power of a base, for
two prime moduli.  Any span's hash follows from two entries, so equality of spans takes
constant time and the longest common extension of two places a binary search.  The
fingerprint has the text's length and whole hash (62 bits) and the SKETCH smallest of the
mixed hashes of all its spans of ``width`` code points; the likeness of two fingerprints is
the share of common values among the smallest of both together (an estimate of the
Jaccard similarity of their spans).

Defined cases: a null text is the empty text; empty texts have a fingerprint of their own
and likeness 1 to each other, 0 to others; short texts use narrower spans; equal texts have
equal fingerprints and likeness 1; repeated rows are neighbours ordered by a hash of their
text; with one document the next one is itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.llm._common import letters_hash, parts_for, per_worker, texts
from labtables.session import scratch_dir

MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1597334677)
WIDTH = 16
SKETCH = 64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


class Powers:
    """Powers of a base, as many as asked for so far."""

    def __init__(self, base: int, modulus: int):
        self.base, self.modulus, self.values = base, modulus, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            # base^0..base^(m-1) times base^m are the next m powers.
            step = np.uint64(int(self.values[-1]) * self.base % self.modulus)
            self.values = np.concatenate([self.values, self.values * step % np.uint64(self.modulus)])
        return self.values[:n]


def _powers(k: int) -> Powers:
    return per_worker(f"powers {k}", lambda: Powers(BASES[k], MODULI[k]))


class Prefixes:
    """Prefix hashes of one text for modulus number k."""

    def __init__(self, points: np.ndarray, k: int = 0):
        self.k, self.n, self.modulus = k, len(points), np.uint64(MODULI[k])
        terms = (points + np.uint64(1)) * _powers(k).upto(self.n) % self.modulus
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.sums %= self.modulus

    def spans(self, starts: np.ndarray | int, width: np.ndarray | int, total: int) -> np.ndarray:
        """Hashes of spans, brought to a common place ``total``, so that texts compare."""
        part = (self.sums[starts + width] + self.modulus - self.sums[starts]) % self.modulus
        return part * _powers(self.k).upto(total + 1)[total - starts] % self.modulus

    def whole(self) -> int:
        return int(self.sums[-1])


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Longest common extension of place i of one text and j of another."""
    total = max(a.n, b.n)
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.spans(i, middle, total) == b.spans(j, middle, total):
            low = middle
        else:
            high = middle - 1
    return low


def _mixed(values: np.ndarray) -> np.ndarray:
    """32 well-mixed bits of each hash."""
    x = values * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def sketch(points: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Length, whole hash and the smallest span hashes (sorted)."""
    n = len(points)
    first, second = Prefixes(points, 0), Prefixes(points, 1)
    whole = first.whole() << 31 | second.whole()
    if not n:
        return 0, whole, np.zeros(0, dtype=np.uint32)
    width = min(WIDTH, max(1, n // 4))
    # Spans hashed from their own start: sums are moved to the text's end, then divided by
    # the power that is left over, which is the same for equal spans only if removed.
    starts = np.arange(n - width + 1)
    powers = _inverse_powers().upto(n)
    part = (first.sums[width:] + first.modulus - first.sums[: n - width + 1]) % first.modulus
    found = _mixed(part * powers[starts] % first.modulus)
    if len(found) > 4 * SKETCH:
        # Spans may repeat, so more than SKETCH values are looked at, and all if those
        # repeat too often.
        near = np.unique(np.partition(found, 3 * SKETCH)[: 3 * SKETCH])
        if len(near) < SKETCH:
            near = np.unique(found)
    else:
        near = np.unique(found)
    return n, whole, near[:SKETCH]


def _inverse_powers() -> Powers:
    return per_worker("inverse", lambda: Powers(pow(BASES[0], -1, MODULI[0]), MODULI[0]))


def written(found: tuple[int, int, np.ndarray]) -> tuple[str, bytes]:
    """Length and whole hash as text, and the sketch's bytes; together the fingerprint."""
    n, whole, values = found
    return f"{n:x}.{whole:016x}.", values.astype(">u4").tobytes()


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    if a[:2] == b[:2]:
        return 1.0
    if not len(a[2]) or not len(b[2]):
        return 0.0
    size = min(SKETCH, max(len(a[2]), len(b[2])))
    lowest = np.union1d(a[2], b[2])[:size]
    both = np.isin(lowest, a[2], assume_unique=True) & np.isin(lowest, b[2], assume_unique=True)
    return float(both.sum() / len(lowest))


def edited(text: str, following: str) -> str:
    """The last third replaced by as many first code points of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


# Sketches stay bytes, half of what their text takes, until the result is read.
_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, sketch binary,"
    " edited_fingerprint string, edited_sketch binary, near_edited double, near_next double,"
    " kept_chars long"
)
_NAMES = [part.split()[0] for part in _RESULT.split(", ")]


def _row(doc: int | None, text: str, mine, following: str, theirs) -> tuple:
    new = edited(text, following)
    points = code_points(new)
    changed = sketch(points)
    kept = common_extension(Prefixes(code_points(text)), 0, Prefixes(points), 0)
    return (
        doc,
        len(text),
        hashlib.sha256(new.encode()).hexdigest(),
        *written(mine),
        *written(changed),
        likeness(mine, changed),
        likeness(mine, theirs),
        kept,
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and likeness to the next document.

    Documents are range partitioned by descending doc_id, the only shuffle of the texts; a
    partition's last document is finished afterwards with the first of the next partition,
    two texts per partition.  kept_chars is how far text and edited text agree.
    """
    spark = docs.sparkSession
    ordered = (
        texts(docs)
        .withColumn("tie", letters_hash("text"))
        .repartitionByRange(parts_for(spark), F.desc("doc_id"), F.desc("tie"))
        .sortWithinPartitions(F.desc("doc_id"), F.desc("tie"))
        .select("doc_id", "text")
    )
    folder = scratch_dir(spark, "fingerprints")
    ordered.mapInPandas(_task, _RESULT + ", part long, first string, last string").write.parquet(
        folder
    )
    found = spark.read.parquet(folder)
    done = found.where("part is null").select(*_NAMES)

    # One row per partition: its first text, and its last document.
    edges = found.where("part is not null").select("part", "doc_id", "first", "last")
    numbers = sorted(row[0] for row in edges.select("part").collect())
    following = dict(zip(numbers, numbers[1:] + numbers[:1], strict=True))
    if not following:
        return _as_text(done)
    after = F.create_map(*[F.lit(x) for pair in following.items() for x in pair])
    pairs = edges.select("doc_id", "last", after[F.col("part")].alias("next")).join(
        edges.select(F.col("part").alias("next"), "first"), "next"
    )
    ends = pairs.select("doc_id", "last", "first").mapInPandas(_ends, _RESULT)
    return _as_text(done.unionByName(ends))


def _as_text(found: DataFrame) -> DataFrame:
    def whole(name: str, sketch: str) -> Column:
        return F.concat(name, F.lower(F.hex(sketch)))

    return found.withColumns(
        {
            "fingerprint": whole("fingerprint", "sketch"),
            "edited_fingerprint": whole("edited_fingerprint", "edited_sketch"),
        }
    ).drop("sketch", "edited_sketch")


def _doc(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    whole = {n: "Int64" for n in ("doc_id", "n_chars", "kept_chars", "part") if n in names}
    return out.astype(whole)


def _task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [*_NAMES, "part", "first", "last"]
    held = None
    first = None
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            now = (_doc(doc), text, sketch(code_points(text)))
            if held is None:
                first = text
            else:
                rows.append((*_row(*held, text, now[2]), None, None, None))
            held = now
        yield _frame(rows, names)
    if held is not None:
        edge = (held[0], *[None] * (len(_NAMES) - 1), TaskContext.get().partitionId(), first, held[1])
        yield _frame([edge], names)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _frame(
            [
                _row(_doc(doc), last, sketch(code_points(last)), first, sketch(code_points(first)))
                for doc, last, first in zip(batch["doc_id"], batch["last"], batch["first"], strict=True)
            ],
            _NAMES,
        )
