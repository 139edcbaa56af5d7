"""Token counts by byte-pair merging with a heap and a linked list.

A text's symbols, at first its characters, form a linked list; a heap holds the adjacent pairs
whose union is a piece of the vocabulary, by rank (equal ranks from left to right).  The lowest
pair is popped and merged, its new neighbours are pushed, until none is left.  The count is that
of the first symbols less the merges; a character outside the vocabulary counts its UTF-8 bytes.
No identifiers are looked up or emitted.

Where two adjacent characters stand next to each other in no piece at all, no merge can cross,
so the list may be cut there without changing the count: in the vocabularies used here that is
at least before the blank of every word.  A batch is cut at such places, its distinct stretches
are merged once each, and a worker keeps the counts of short ones (a bounded number); all else
is a row-wise pass without a shuffle.

Texts are normalised as the vocabulary says (by the library: blanks become marks, one is put in
front).  Names of special tokens inside a text are ordinary text, as by the library's default.

Defined cases: a null text counts as the empty one, which has no tokens; a repeated row is
counted again; null doc_ids and other columns are left as they are; very long texts are worked
on whole, and one long stretch without any cut takes time n log n; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from labtables.llm._common import give_back, per_worker, texts

#: Counted stretches that a worker keeps in each of two halves (some 100 bytes each); when the young
#: half is full it becomes the old one.  Stretches longer than LONG characters are not kept.
KEPT, LONG = 250_000, 64
#: Characters that are cut at once (a longer single text is cut alone).
SLICE_CHARS = 1 << 20
#: Tokens that fit into a training sequence.
LIMIT = 4096

_PROBES = ["", "a  b\n", "The quick brown fox, 12345 times!", "naïve über-Straße 中文 \U0001f600", "<s>aaaaaaaaaa"]


class Merger:
    """Counts tokens by one byte-pair vocabulary with bytes for unknown characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(model.is_byte(i), model.is_control(i) or model.is_unknown(i)) for i in range(len(model))]
        plain = [i for i, (byte, special) in enumerate(kinds) if not (byte or special)]
        if any(model.is_unused(i) for i in plain) or not any(byte for byte, _ in kinds):
            raise ValueError("the vocabulary needs a byte for each unknown character, and no unused pieces")
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank_of = {score: rank for rank, score in enumerate(scores)}
        # The mark for a blank is written as a blank again, which no normalised text holds.
        self.normalize = lambda text: model.normalize(text).replace("\u2581", " ")
        pieces = {
            model.id_to_piece(i).replace("\u2581", " "): rank_of[model.get_score(i)] for i in plain
        }
        self.ranks = {piece: rank for piece, rank in pieces.items() if len(piece) > 1}
        self.single = {piece for piece in pieces if len(piece) == 1}
        inside = sorted({letter for piece in self.ranks for letter in piece})
        if not self.single.issuperset(inside):
            raise ValueError("the vocabulary merges characters that it does not hold")
        # Characters of no longer piece are class 0, which is next to nothing in any piece.
        self.classes = np.zeros(0x110000, dtype=np.uint16)
        self.classes[[ord(letter) for letter in inside]] = np.arange(1, len(inside) + 1)
        self.width = len(inside) + 1
        self.adjacent = np.zeros(self.width * self.width, dtype=bool)
        for piece in self.ranks:
            codes = self.classes[[ord(letter) for letter in piece]].astype(np.int64)
            self.adjacent[codes[:-1] * self.width + codes[1:]] = True
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        for probe in _PROBES:
            if self.counts([probe])[0] != len(model.encode(probe)):
                raise ValueError("not a byte-pair vocabulary of this kind")

    def merges(self, text: str) -> int:
        """Pairs of adjacent symbols that are merged, lowest rank first."""
        n = len(text)
        rank_of = self.ranks.get
        after = [*range(1, n + 1)]  # where the next symbol begins; 0 once merged away
        before = [*range(-1, n - 1)]
        heap = [
            rank * n + i for i in range(n - 1) if (rank := rank_of(text[i : i + 2])) is not None
        ]
        heapify(heap)
        done = 0
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if not j or j == n:
                continue
            k = after[j]
            if rank_of(text[i:k]) != rank:
                continue  # one of the pair has been merged meanwhile
            after[i], after[j] = k, 0
            done += 1
            h = before[i]
            if h >= 0 and (rank := rank_of(text[h:k])) is not None:
                heappush(heap, rank * n + h)
            if k < n:
                before[k] = i
                if (rank := rank_of(text[i : after[k]])) is not None:
                    heappush(heap, rank * n + i)
        return done

    def _count(self, stretch: str) -> int:
        n = len(stretch)
        if not stretch.isascii() or not self.single.issuperset(stretch):
            n = sum(1 if letter in self.single else len(letter.encode()) for letter in stretch)
        return n - self.merges(stretch)

    def _counts(self, stretches: list[str]) -> np.ndarray:
        """Counts of distinct stretches."""
        found = [*map(self.young.get, stretches)]
        for at, known in enumerate(found):
            if known is not None:
                continue
            stretch = stretches[at]
            known = self.old.get(stretch)
            found[at] = known = self._count(stretch) if known is None else known
            if len(stretch) <= LONG:
                if len(self.young) >= KEPT:
                    self.young, self.old = {}, self.young
                self.young[stretch] = known
        return np.array(found, dtype=np.int64)

    def _slice(self, batch: list[str]) -> np.ndarray:
        joined = "".join(batch)
        if not joined:
            return np.zeros(len(batch), dtype=np.int64)
        ends = np.cumsum([len(text) for text in batch])
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        codes = self.classes[points].astype(np.int32)
        begins = np.ones(len(points), dtype=bool)
        begins[1:] = ~self.adjacent[codes[:-1] * self.width + codes[1:]]
        begins[ends[ends < len(points)]] = True
        at = np.flatnonzero(begins)
        data = joined.encode()
        offsets = np.append(at, len(points))
        if len(data) > len(points):
            size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
            offsets = np.concatenate(([0], np.cumsum(size)))[offsets]
        spans = pa.Array.from_buffers(
            pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
        ).dictionary_encode()
        tokens = self._counts(spans.dictionary.to_pylist())[spans.indices.to_numpy(zero_copy_only=False)]
        sums = np.concatenate(([0], np.cumsum(tokens)))
        return np.diff(sums[np.searchsorted(at, np.concatenate(([0], ends)))])

    def counts(self, batch: list[str]) -> np.ndarray:
        """Number of tokens of each text, whole texts a slice at a time."""
        out, held, size = [], [], 0
        for text in batch:
            text = self.normalize(text)
            held.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                out.append(self._slice(held))
                held, size = [], 0
        out.append(self._slice(held))
        return np.concatenate(out)


def count(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every document.

    ``vocabulary`` is a path that every executor can open.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merger = per_worker(f"merger {vocabulary}", lambda: Merger(vocabulary))
        for frame in frames:
            tokens = merger.counts(frame["text"].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "n_bytes": [len(text.encode()) for text in frame["text"]],
                    "n_tokens": tokens,
                    "over_limit": tokens > limit,
                }
            )
            give_back()

    return texts(docs).mapInPandas(
        batches, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
