"""Language identification by a blended-spectrum string kernel.

A text is the set of its letter n-grams (1 to 3, lower case) that occur in the learning
sample; the kernel of two texts is the mean over n of the shared n-grams divided by the
root of the product of both counts (presence, not frequency).  Every letter and combining mark
of any script counts as itself, everything else (digits, marks, white space but the blank) as one
sign; each language of the sample brings its own most frequent n-grams.  Nyström landmarks from the
sample give features, one-versus-rest kernel ridge regression gives each language a score.
As the kernel is a product of n-gram rows with landmark rows, landmark and regression
matrices are multiplied once after learning, and a batch of texts is scored by one matrix
product per n.

The sample is bounded by SAMPLE_TEXTS; which rows it has is decided by a hash of doc_id.
Everything else is a row-wise pass: no shuffle, and memory of one slice of texts.

Defined cases: a text that is null, empty or without a letter gets ``und`` and score 0; rows
without language or with a blank one are not learned from; without any row to learn from
every text gets ``und``; equal scores go to the first language in alphabetical order; a null
doc_id counts as the empty string in the hash; repeated rows and other columns do no harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.llm._common import give_back, letters_hash, per_worker, texts

UNKNOWN = "und"
#: Texts learned from at most, shared evenly among the languages.
SAMPLE_TEXTS = 1600
LANDMARKS = 240
RIDGE = 1e-2
SIZES = (1, 2, 3)
#: N-grams of each size that count: those in most texts of each language, which share this
#: number evenly but have LEAST_GRAMS each, however many languages there are.
GRAMS, LEAST_GRAMS = 8192, 512
#: Cells of texts x n-grams that are held at once.
CELLS = 8 << 20
#: Code points that are handled at once; a longer text is handled in several slices.
SLICE = 1 << 20

_BITS = 21  # three code points in one number
_LETTER = re.compile(r"[^\W\d_]")
_WIDE = 0x110000


@dataclass
class Model:
    languages: list[str]
    columns: dict[int, np.ndarray]  # n -> sorted n-grams of the sample
    weights: dict[int, np.ndarray]  # n -> columns x languages


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that is never learned from."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key) % 4 == 2


def _own_code() -> np.ndarray:
    """Code point -> itself for letters, combining marks and the blank, otherwise 0."""
    points = np.arange(_WIDE, dtype=np.int64)
    own = [c == 32 or unicodedata.category(chr(c))[0] in "LM" for c in range(_WIDE)]
    return np.where(own, points, 0)


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return per_worker("letters of all scripts", _own_code)[points]


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that begins at each place, as one number."""
    gram = codes[: max(len(codes) - n + 1, 0)].copy()
    for k in range(1, n):
        gram = (gram << _BITS) | codes[k : len(codes) - n + 1 + k]
    return gram


def _present(texts_: list[str], columns: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """n -> texts x columns, 1 where the n-gram occurs; whole texts, a slice at a time."""
    out = {n: np.zeros((len(texts_), len(c)), np.float32) for n, c in columns.items()}
    held: list[tuple[int, np.ndarray]] = []

    def put() -> None:
        rows = np.concatenate([np.full(len(codes), row) for row, codes in held])
        codes = np.concatenate([codes for _, codes in held])
        for n, column in columns.items():
            if len(codes) < n or not len(column):
                continue
            gram = _grams(codes, n)
            first, last = rows[: len(gram)], rows[n - 1 :]
            found = np.minimum(np.searchsorted(column, gram), len(column) - 1)
            use = (column[found] == gram) & (first == last)
            out[n][first[use], found[use]] = 1
        held.clear()

    size = 0
    for row, text in enumerate(texts_):
        codes = _codes(text)
        for start in range(0, len(codes), SLICE):
            held.append((row, codes[start : start + SLICE + max(SIZES) - 1]))
            size += len(held[-1][1])
            if size >= SLICE:
                put()
                size = 0
    if held:
        put()
    return out


def _scaled(present: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Rows divided by the root of their count, so that products are the kernel's parts."""
    return {
        n: p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1)) for n, p in present.items()
    }


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """Learn from (text, language); None without any."""
    if not sample:
        return None
    languages = sorted({language for _, language in sample})
    words = [text for text, _ in sample]
    each = max(LEAST_GRAMS, GRAMS // len(languages))
    kept: dict[int, list[np.ndarray]] = {n: [] for n in SIZES}
    for language in languages:
        own = [_codes(text) for text, l in sample if l == language]
        for n in SIZES:
            every = np.concatenate([np.unique(_grams(codes, n)) for codes in own])
            grams, seen = np.unique(every, return_counts=True)
            kept[n].append(grams[np.argsort(-seen, kind="stable")[:each]])
    columns = {n: np.unique(np.concatenate(kept[n])) for n in SIZES}

    # The sample comes in order of a hash, so every so-many-th row is a fair choice.
    chosen = np.unique(np.linspace(0, len(words) - 1, min(LANDMARKS, len(words))).astype(int))
    landmarks = _scaled(_present([words[i] for i in chosen], columns))
    between = sum(landmarks[n] @ landmarks[n].T for n in SIZES).astype(float) / len(SIZES)
    values, vectors = np.linalg.eigh(between)
    good = values > values.max(initial=0) * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    at_once = max(1, CELLS // max(sum(map(len, columns.values())), 1))
    parts = []
    for start in range(0, len(words), at_once):
        rows = _scaled(_present(words[start : start + at_once], columns))
        parts.append(sum(rows[n] @ landmarks[n].T for n in SIZES) / len(SIZES))
    features = np.concatenate(parts) @ root
    features = np.hstack([features, np.ones((len(words), 1))])
    targets = np.array([[1.0 if l == m else -1.0 for m in languages] for _, l in sample])
    # Each language weighs the same, however many texts it has.
    share = {m: sum(1 for _, l in sample if l == m) for m in languages}
    weight = np.array([len(sample) / (len(languages) * share[l]) for _, l in sample])[:, None]
    gram = features.T @ (features * weight) + RIDGE * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (targets * weight))
    weights = {
        n: (landmarks[n].T @ (root @ beta[:-1]) / len(SIZES)).astype(np.float32) for n in SIZES
    }
    weights[0] = beta[-1:].astype(np.float32)
    return Model(languages, columns, weights)


def score(model: Model, texts_: list[str]) -> np.ndarray:
    """texts x languages, about 1 for the language and -1 for the others."""
    rows = _scaled(_present(texts_, model.columns))
    return sum(rows[n] @ model.weights[n] for n in SIZES) + model.weights[0]


def learning_sample(docs: DataFrame, language: str = "lang") -> list[tuple[str, str]]:
    """At most SAMPLE_TEXTS (text, language) of the rows that may be learned from."""
    usable = docs.select("doc_id", "text", F.col(language).alias("language")).where(
        ~held_out() & F.col("text").rlike(r"\p{L}") & (F.trim("language") != "")
    )
    counts = {r[0]: r[1] for r in usable.groupBy("language").count().collect()}
    if not counts:
        return []
    each = max(1, SAMPLE_TEXTS // len(counts))
    # About twice as many as wanted pass the threshold, then the smallest hashes stay.
    place = F.pmod(letters_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30))
    limits = F.create_map(
        *[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1, 2 * each / n) * (1 << 30))))]
    )
    near = usable.withColumn("place", place).where(F.col("place") < limits[F.col("language")])
    taken: dict[str, int] = {}
    sample = []
    rows = near.orderBy("place", letters_hash("text")).limit(4 * SAMPLE_TEXTS).collect()
    for row in rows:
        taken[row.language] = taken.get(row.language, 0) + 1
        if taken[row.language] <= each:
            sample.append((row.text, row.language))
    return sample


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` as they are, with lang_pred and score; reads only the text."""
    names = docs.columns
    # Bounded by the sample.
    given = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def task(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        learned = Model(**given.value) if given.value else None
        size = max(8, (2 << 20) // max(sum(len(w) for w in learned.weights.values()), 1)) if learned else 1
        for batch in batches:
            labels, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            usable = [
                i
                for i, text in enumerate(batch)
                if learned is not None and text and _LETTER.search(text)
            ]
            for start in range(0, len(usable), size):
                part = usable[start : start + size]
                found = score(learned, [batch.iloc[i] for i in part])
                best = found.argmax(axis=1)
                for i, row, k in zip(part, found, best, strict=True):
                    labels[i] = learned.languages[k]
                    scores[i] = float(np.clip((row[k] + 1) / 2, 0, 1))
            yield pd.DataFrame({"lang_pred": labels, "score": scores})
            give_back()

    # A deterministic one would be worked out once more below a filter on its results, by a
    # second Python worker of every task.
    mark = F.pandas_udf(task, "lang_pred string, score double").asNondeterministic()
    found = docs.select("*", mark(F.coalesce("text", F.lit(""))).alias("__found"))
    return found.select(*[F.col(f"`{n}`") for n in names], "__found.lang_pred", "__found.score")
