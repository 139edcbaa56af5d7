"""Words of whole texts and hashes of runs of words, in numpy.

A text's bytes, its words and its windows are never lists of Python objects: words are spans
of the UTF-8 bytes, a word's hash comes from prefix sums over mixed bytes, and the hash of a run
of words from prefix sums over word hashes (all modulo 2^64, then mixed).
"""

from __future__ import annotations

import numpy as np

# Bytes between words: blank, tab, line ends and the like.
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True

_POWERS: dict[int, np.ndarray] = {}
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    found = _POWERS.get(base, np.ones(1, dtype=np.uint64))
    while len(found) < n:
        step = np.uint64(int(found[-1]) * base % (1 << 64))
        found = np.concatenate([found, found * step])
    _POWERS[base] = found
    return found[:n]


def _span_hashes(terms: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Hash of terms[start:stop] for every span."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(terms) + 1, dtype=np.uint64)
    np.cumsum(terms * _powers(base, len(terms)), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return mixed((sums[stops] - sums[starts]) * _powers(inverse, len(terms) + 1)[starts])


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words in UTF-8 bytes."""
    inside = np.zeros(len(text) + 2, dtype=bool)
    inside[1:-1] = ~_GAP[np.frombuffer(text, dtype=np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, starts: np.ndarray, stops: np.ndarray, which: int = 0) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    return _span_hashes(_BYTES[data], starts, stops, BASES[which])


def run_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of every ``size`` consecutive words."""
    starts = np.arange(max(len(words) - size + 1, 0))
    return _span_hashes(words, starts, starts + size, BASES[1 - which])
