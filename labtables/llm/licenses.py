"""License scan: a suffix automaton over the words of license texts.

The templates' words go into one generalised suffix automaton.  A text is streamed through
it: at each word the automaton knows the longest run of words ending there that occurs in
some template (matching statistics).  Runs of at least MIN_RUN words that cannot be
extended are anchors; anchors of one template that follow each other in order, in the
template and in the text, with gaps of at most MAX_GAP words, are chained, and a chain that
covers at least COVER of its template is a span of that license.

The scan is one row-wise pass without a shuffle.  The automaton has a few thousand states.

Base phrases (``PHRASES``) are found apart from it, wherever their words stand together.

Defined cases: a null text is the empty text, with no words; a text without hits has empty
labels, null places and score 0; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.llm._common import per_worker, texts

# Phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices as their licenses ask for them or as they open.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl", "this work is licensed under the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    ("cc-by", "this work is licensed under a Creative Commons Attribution"),
    ("cc-by", "licensed under CC BY 4.0"),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    ("reserved", "all rights reserved"),
)

MIN_RUN = 3
MAX_GAP = 8
COVER = 0.6

# Bytes of words: letters and digits of ASCII, and all beyond it.
_WORD = np.ones(256, dtype=bool)
_WORD[: 0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_WORD[ord("A") : ord("Z") + 1] = True  # read in lower case
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(text: str) -> list[str]:
    """The words of a text, A to Z in lower case."""
    data = bytes(_LOWER[np.frombuffer(text.encode(), dtype=np.uint8)])
    mask = np.concatenate(([False], _WORD[np.frombuffer(data, dtype=np.uint8)], [False]))
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    return [data[a:b].decode() for a, b in zip(edges[::2], edges[1::2], strict=True)]


@dataclass
class Automaton:
    """Suffix automaton of several word sequences, built one word at a time."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    # Where the state's words end: (template, number of words up to there).
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.step[copy], self.link[copy] = dict(self.step[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, word: int) -> int:
        if word in self.step[last]:
            q = self.step[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            right = self.length[p] + 1 == self.length[q]
            self.link[new] = q if right else self._split(p, q, word)
        return new

    def add(self, template: int, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            last = self._add(last, word)

    def close(self, sequences: list[list[int]]) -> None:
        """Note for every state where its words end in the templates."""
        for template, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence, 1):
                state = self.step[state][word]
                up = state
                while up > 0:
                    self.ends[up].add((template, place))
                    up = self.link[up]


class Scanner:
    def __init__(self):
        self.templates = [words(text) for _, text in TEMPLATES]
        phrases = [phrase.split(" ") for phrase, _ in PHRASES]
        vocabulary = sorted({w for one in [*self.templates, *phrases] for w in one})
        self.number = {word: i for i, word in enumerate(vocabulary)}
        self.phrases = [[self.number[w] for w in one] for one in phrases]
        sequences = [[self.number[w] for w in one] for one in self.templates]
        self.automaton = Automaton()
        for template, sequence in enumerate(sequences):
            self.automaton.add(template, sequence)
        self.automaton.close(sequences)
        keys = np.array([_key(word) for word in vocabulary], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.longest = max(len(word.encode()) for word in vocabulary)

    def numbers(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words; places and numbers of those that templates or phrases have."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        mask = np.zeros(len(data) + 2, dtype=bool)
        mask[1:-1] = _WORD[data]
        edges = np.flatnonzero(mask[1:] != mask[:-1])
        starts, stops = edges[::2], edges[1::2]
        near = np.flatnonzero(stops - starts <= self.longest)
        if not len(near):
            return len(starts), near, near
        # A key from the word's bytes finds candidates; the word itself decides.
        lower = _LOWER[data]
        offset = starts[near]
        width = stops[near] - offset
        key = np.zeros(len(near), dtype=np.uint64)
        for k in range(int(width.max())):
            more = width > k
            key[more] = (key[more] + lower[offset[more] + k] + np.uint64(1)) * _FACTOR
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        found = [
            (near[i], self.number.get(lower[offset[i] : offset[i] + width[i]].tobytes().decode(), -1))
            for i in hit
        ]
        found = [(place, number) for place, number in found if number >= 0]
        return (
            len(starts),
            np.array([p for p, _ in found], dtype=np.int64),
            np.array([n for _, n in found], dtype=np.int64),
        )

    def matches(self, places: np.ndarray, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, words, state) of runs of at least MIN_RUN that cannot be extended."""
        runs, a = [], self.automaton
        state = length = 0
        before = -2
        for place, number in zip(places.tolist(), numbers.tolist(), strict=True):
            grown = place == before + 1 and number in a.step[state]
            if not grown and length >= MIN_RUN:
                runs.append((before - length + 1, length, state))
            if place != before + 1:
                state = length = 0
            while state and number not in a.step[state]:
                state = a.link[state]
                length = a.length[state]
            if number in a.step[state]:
                state = a.step[state][number]
                length += 1
            else:
                state = length = 0
            before = place
        if length >= MIN_RUN:
            runs.append((before - length + 1, length, state))
        return runs

    def spans(self, places: np.ndarray, numbers: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template) of chained runs."""
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for first, size, state in self.matches(places, numbers):
            for template, end in sorted(self.automaton.ends[state]):
                anchors.setdefault(template, []).append((first, end - size, size))
        out = []
        for template, found in sorted(anchors.items()):
            whole = len(self.templates[template])
            chain: list[tuple[int, int, int]] = []
            for anchor in [*found, None]:
                if chain and anchor:
                    first, at, size = anchor
                    gap = first - (chain[-1][0] + chain[-1][2])
                    if -size < gap <= MAX_GAP and at > chain[-1][1]:
                        chain.append(anchor)
                        continue
                if chain:
                    covered = len({w for _, at, size in chain for w in range(at, at + size)})
                    if covered >= COVER * whole:
                        end = chain[-1][0] + chain[-1][2]
                        out.append((TEMPLATES[template][0], chain[0][0], end, covered / whole))
                chain = [anchor] if anchor else []
        return out

    def base(self, places: np.ndarray, numbers: np.ndarray) -> list[tuple[int, str]]:
        """(first word, label) of every place where a phrase's words stand together."""
        out = []
        at = dict(zip(places.tolist(), numbers.tolist(), strict=True))
        for phrase, (_, label) in zip(self.phrases, PHRASES, strict=True):
            for place in places[numbers == phrase[0]].tolist():
                if all(at.get(place + k) == word for k, word in enumerate(phrase)):
                    out.append((place, label))
        return out


def _key(word: str) -> int:
    key = 0
    for byte in word.encode():
        key = (key + byte + 1) * int(_FACTOR) % (1 << 64)
    return key


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long,"
    " base_labels string, labels string, score double, spans string"
)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document; score is 1 with a base phrase, else the best template's share.

    spans lists label:first word:end word of the chained template spans.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = per_worker("license scanner", Scanner)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                n, places, numbers = scanner.numbers(text)
                base = scanner.base(places, numbers)
                spans = scanner.spans(places, numbers)
                mine = {label for _, label in base}
                rows.append(
                    (
                        doc,
                        n,
                        len(base),
                        min((p for p, _ in base), default=None),
                        max((p for p, _ in base), default=None),
                        ",".join(sorted(mine)),
                        ",".join(sorted(mine | {span[0] for span in spans})),
                        1.0 if base else max((span[3] for span in spans), default=0.0),
                        ",".join(f"{label}:{a}:{b}" for label, a, b, _ in spans),
                    )
                )
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return texts(docs).mapInPandas(task, SCHEMA)
