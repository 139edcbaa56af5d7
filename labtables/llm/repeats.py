"""Substring deduplication with fixed-block anchors.

Words are kept as they are; a window is WINDOW consecutive words of one document.  A word goes if
a window over it also starts in a document of smaller doc_id.

1. Every document indexes its non-overlapping blocks of ANCHOR = WINDOW / 2 words and probes with
   every rolling run of that length.  Any repeated window contains a whole block of the other
   document, so a repeat cannot be missed.
2. A run that two documents share, one of them as a block, is a hit; hits are extended to all
   windows that contain them, and these are compared by 96 bits of hash.  The windows that also
   start in a smaller document, together, are the maximal repeats.

Documents are dealt by doc_id and text into groups of about GROUP_CHARS characters.  A group sends each
distinct run (4 bytes) or window (12 bytes and its smallest document) once to the range of hashes
it belongs to, and gets back what other groups have as well.  A passage that very many documents
share is thus one entry per group, never one per document.  The texts are shuffled once; the
three steps that read them reuse that exchange.

Defined cases: a null text has no words; documents shorter than a window keep all words; equal
doc_ids are not smaller than each other, a null doc_id counts as larger than any; repeats inside
one document stay; repeated rows are kept each; a very long text is a group's task by itself, whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.llm._common import letters_hash, texts
from labtables.llm._words import run_hashes, word_hashes, word_spans

WINDOW = 50
ANCHOR = WINDOW // 2
GROUP_CHARS = 6 << 20
_LAST = np.iinfo(np.int64).max

_ROWS = "place int, grp int, hashes binary, more binary, docs binary"


def _bits(groups: int) -> int:
    return max(groups - 1, 0).bit_length()


def _range(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of 2^bits equal ranges of hashes."""
    return ((hashes >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")


class _Group:
    """The documents of a group: words, and where each one's runs lie."""

    def __init__(self, rows: pd.DataFrame):
        self.docs = rows["doc_id"].fillna(_LAST).astype("int64").to_numpy()
        self.texts = [text.encode() for text in rows["text"]]
        self.words: list[np.ndarray] = []
        for text in self.texts:
            self.words.append(word_hashes(text, *word_spans(text)))

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document number and first word of every run of ``size`` words."""
        found = [run_hashes(words, size) for words in self.words]
        counts = [len(one) for one in found]
        number = np.repeat(np.arange(len(found)), counts)
        place = np.concatenate([np.arange(n) for n in counts] or [np.zeros(0, np.int64)])
        return np.concatenate(found or [np.zeros(0, np.uint64)]), number, place

    def checks(self) -> np.ndarray:
        """32 more bits of hash for every window."""
        found = [
            run_hashes(word_hashes(text, *word_spans(text), 1), WINDOW, 1) for text in self.texts
        ]
        return _low(np.concatenate(found or [np.zeros(0, np.uint64)]))


def _split(sorted_hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the ranges that sorted hashes fall into."""
    if not len(sorted_hashes):
        return []
    ranges = _range(sorted_hashes, bits)
    at = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
    return [
        (int(ranges[a]), int(a), int(b))
        for a, b in zip(at, np.append(at[1:], len(ranges)), strict=True)
    ]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["place", "grp", "hashes", "more", "docs"])


def _dealt(docs: DataFrame, groups: int) -> DataFrame:
    """Documents with their group, by doc_id and text: ids may be null or repeated."""
    group = F.pmod(letters_hash("doc_id", "text"), F.lit(groups)).cast("int")
    return texts(docs).withColumn("grp", group)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    total = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_CHARS))
    bits = _bits(groups)

    def send_runs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes, _, place = _Group(rows).runs(ANCHOR)
        every, blocks = np.unique(hashes), np.unique(hashes[place % ANCHOR == 0])
        ranges = _range(blocks, bits)
        out = []
        for k, a, b in _split(every, bits):
            first, end = np.searchsorted(ranges, [k, k + 1])
            own = _low(blocks[first:end]).tobytes()
            out.append((k, int(key[0]), _low(every[a:b]).tobytes(), own, None))
        return _frame(out)

    def match_runs(rows: pd.DataFrame) -> pd.DataFrame:
        every = [np.frombuffer(x, "<u4") for x in rows["hashes"]]
        joined = np.sort(np.concatenate(every))
        shared = np.unique(joined[1:][joined[1:] == joined[:-1]])
        blocks = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in rows["more"]]))
        hits = np.intersect1d(shared, blocks, assume_unique=True)
        out = []
        for place, group, own in zip(rows["place"], rows["grp"], every, strict=True):
            found = own[np.isin(own, hits)]
            if len(found):
                out.append((int(place), int(group), found.tobytes(), None, None))
        return _frame(out)

    def send_windows(key: tuple, rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _frame([])
        group = _Group(rows)
        hashes, number, place = group.runs(ANCHOR)
        wanted = [
            (np.uint64(k) << np.uint64(32)) | np.frombuffer(x, "<u4").astype(np.uint64)
            for k, x in zip(hits["place"], hits["hashes"], strict=True)
        ]
        keys = (_range(hashes, bits).astype(np.uint64) << np.uint64(32)) | _low(hashes)
        hit = np.isin(keys, np.concatenate(wanted)) if wanted else np.zeros(len(keys), bool)
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        hit |= times[which] > 1
        # Windows, in the order of ``runs``, that contain a hit.
        counts = np.array([max(len(w) - WINDOW + 1, 0) for w in group.words])
        first = np.concatenate(([0], np.cumsum(counts)))
        edge = np.zeros(first[-1] + 1, dtype=np.int64)
        low = np.maximum(place[hit] - (WINDOW - ANCHOR), 0)
        high = np.minimum(place[hit], counts[number[hit]] - 1)
        fine = high >= low
        np.add.at(edge, first[number[hit]][fine] + low[fine], 1)
        np.add.at(edge, first[number[hit]][fine] + high[fine] + 1, -1)
        chosen = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        windows, of, _ = group.runs(WINDOW)
        windows, owner, check = windows[chosen], group.docs[of[chosen]], group.checks()[chosen]
        order = np.lexsort((owner, windows))
        windows, owner, check = windows[order], owner[order], check[order]
        new = np.concatenate(([True], windows[1:] != windows[:-1])) if len(windows) else order > 0
        windows, owner, check = windows[new], owner[new], check[new]
        out = []
        for k, a, b in _split(windows, bits):
            names, at = np.unique(owner[a:b], return_inverse=True)
            more = check[a:b].tobytes() + at.astype("<u4").tobytes()
            out.append((k, int(key[0]), windows[a:b].astype("<u8").tobytes(), more, names.tobytes()))
        return _frame(out)

    def match_windows(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, "<u8") for x in rows["hashes"]]
        sizes = [len(x) for x in hashes]
        more = [np.frombuffer(x, "<u4") for x in rows["more"]]
        owner = np.concatenate(
            [
                np.frombuffer(d, np.int64)[m[n:]]
                for d, m, n in zip(rows["docs"], more, sizes, strict=True)
            ]
        )
        check = np.concatenate([m[:n] for m, n in zip(more, sizes, strict=True)])
        every, sender = np.concatenate(hashes), np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((owner, check, every))
        every, check, owner, sender = every[order], check[order], owner[order], sender[order]
        new = np.concatenate(([True], (every[1:] != every[:-1]) | (check[1:] != check[:-1])))
        smallest = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = owner > smallest
        every, sender = every[gone], sender[gone]
        out = []
        for i in np.unique(sender):
            found = every[sender == i].tobytes()
            out.append((int(rows["place"].iloc[i]), int(rows["grp"].iloc[i]), found, None, None))
        return _frame(out)

    def remove(key: tuple, rows: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
        group = _Group(rows)
        windows, number, place = group.runs(WINDOW)
        owner = group.docs[number]
        order = np.lexsort((owner, windows))
        ordered = windows[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(order) else order > 0
        bad = np.zeros(len(windows), dtype=bool)
        bad[order] = owner[order] > owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        if len(gone):
            bad |= np.isin(windows, np.concatenate([np.frombuffer(x, "<u8") for x in gone["hashes"]]))
        lost: dict[int, list[int]] = {}
        for n, at in zip(number[bad].tolist(), place[bad].tolist(), strict=True):
            lost.setdefault(n, []).append(at)
        out = []
        for i, text in enumerate(group.texts):
            words, removed = text.split(), 0
            if i in lost:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, lost[i], 1)
                np.add.at(edge, np.array(lost[i]) + WINDOW, -1)
                covered = np.cumsum(edge[:-1]) > 0
                removed = int(covered.sum())
                kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            else:
                kept = words
            doc = rows["doc_id"].iloc[i]
            doc = None if pd.isna(doc) else int(doc)
            out.append((doc, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
        found = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
        return found.astype({"doc_id": "Int64"})

    dealt = _dealt(docs, groups)
    hits = (
        dealt.groupBy("grp").applyInPandas(send_runs, _ROWS)
        .groupBy("place").applyInPandas(match_runs, _ROWS)
    )
    gone = (
        dealt.groupBy("grp").cogroup(hits.groupBy("grp")).applyInPandas(send_windows, _ROWS)
        .groupBy("place").applyInPandas(match_windows, _ROWS)
    )
    return (
        dealt.groupBy("grp")
        .cogroup(gone.groupBy("grp"))
        .applyInPandas(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )
