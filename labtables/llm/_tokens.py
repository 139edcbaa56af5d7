"""Token ids of whole texts by the ``tokenizers`` library, one call per distinct word.

The vocabularies used here cut a text into runs of letters, of marks and of white space
before they look at ids, so the ids of a text are those of its pieces in order, if the
pieces begin where such a run surely begins.  A text that holds the name of an added token
(``<|endoftext|>``) goes to the library as a whole, which cuts it there first.  Arrow finds the distinct pieces of a batch,
a worker asks the library once for each and keeps the ids.  The tests compare whole texts
with the library's own encoding of them.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from labtables.llm._common import per_worker

#: Distinct pieces in each of the two halves of a worker's memory: when the young half is
#: full it becomes the old one, and pieces met again move back, so frequent ones stay.
KEPT_PIECES = 250_000
#: Bytes of text that are cut at once (a longer single text is cut alone).
SLICE_BYTES = 2 << 20

# Kinds of bytes in UTF-8.  Of letters beyond ASCII only U+00C0 to U+027F count as such;
# next to any other character no cut is made.
_BLANK, _WHITE, _LETTER, _MARK, _OTHER, _RISKY, _LEAD, _FOLLOW = range(8)
_KIND = np.full(256, _RISKY, dtype=np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[ord("A") : ord("Z") + 1] = _LETTER
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[[ord(mark) for mark in ".,;:!?*#$%&"]] = _MARK
_KIND[9:14] = _WHITE
_KIND[32] = _BLANK
_KIND[0xC3:0xCA] = _LEAD


def cut(data: np.ndarray) -> np.ndarray:
    """Where pieces begin in UTF-8 bytes: before a word's blank, between letters and marks,
    and around a single line end."""
    kind = _KIND[data]
    kind[1:][kind[:-1] == _LEAD] = _FOLLOW
    signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    kind[signs] = kind[signs + 1] = _RISKY  # the multiplication and division signs
    one, two, three = kind[:-2], kind[1:-1], kind[2:]

    def sure(k: np.ndarray) -> np.ndarray:
        return (k == _LETTER) | (k == _MARK) | (k == _OTHER) | (k == _LEAD)

    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-2] |= (two == _BLANK) & sure(three)
    ends = (one == _LETTER) | (one == _FOLLOW) | (one == _MARK) | (one == _OTHER)
    line = (two == _WHITE) & ends & sure(three)
    begins[1:-2] |= line
    begins[2:-1] |= line
    left, right = kind[:-1], kind[1:]
    begins[1:-1] |= (right == _MARK) & ((left == _LETTER) | (left == _FOLLOW))
    begins[1:-1] |= (left == _MARK) & ((right == _LETTER) | (right == _LEAD))
    return begins[:-1]


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [byte for byte in range(256) if byte not in plain]
    return {byte: byte if byte in plain else 256 + odd.index(byte) for byte in range(256)}


class Encoder:
    """Ids of texts by one vocabulary file."""

    def __init__(self, path: str, names_are_text: bool = True):
        """With ``names_are_text`` a special token's name inside a text is ordinary text; without,
        it is that token, which is the library's default and what the operators use."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = names_are_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = [re.escape(t.content.encode().lower()) for t in added if not (names_are_text and t.special)]
        # More texts than needed may match (other case); those are only slower.
        self.added = re.compile(b"|".join(names), re.IGNORECASE) if names else None
        # A vocabulary that drops white space has no use for the blank before a word.
        self.keeps_blanks = "Removed" not in json.dumps(
            json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        )
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ask(self, pieces: list[str]) -> dict[str, bytes]:
        """Letters alone are one run of either vocabulary and go straight to its model."""
        learned: dict[str, bytes] = {}
        others = []
        model, normalizer, letters = self.tokenizer.model, self.tokenizer.normalizer, self.letters
        for piece in pieces:
            bare = piece[1:] if piece[0] == " " else piece
            if not bare.isalpha():
                others.append(piece)
                continue
            run = piece if self.keeps_blanks else bare
            run = normalizer.normalize_str(run) if normalizer else run
            run = run.encode().decode("latin-1").translate(letters)
            learned[piece] = array("I", [token.id for token in model.tokenize(run)]).tobytes()
        if others:
            encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
            for piece, one in zip(others, encoded, strict=True):
                learned[piece] = array("I", one.ids).tobytes()
        return learned

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; the library is asked for those not kept."""
        found = [*map(self.young.get, pieces)]
        missed = [piece for piece, ids in zip(pieces, found, strict=True) if ids is None]
        if missed:
            learned = {piece: self.old[piece] for piece in missed if piece in self.old}
            learned |= self._ask([piece for piece in missed if piece not in learned])
            if len(self.young) + len(learned) > KEPT_PIECES:
                self.young, self.old = {}, self.young
            self.young.update(learned)
            found = [
                ids if ids is not None else learned[piece]
                for piece, ids in zip(pieces, found, strict=True)
            ]
        return found

    def _slice(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"".join(texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        if not len(data):
            return [np.zeros(0, dtype="<u4") for _ in texts]
        ends = np.cumsum([len(text) for text in texts])
        begins = cut(data) if len(data) > 2 else np.zeros(len(data), dtype=bool)
        begins[0] = True
        begins[ends[ends < len(data)]] = True
        offsets = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(
            pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined)]
        ).dictionary_encode()
        which = pieces.indices.to_numpy(zero_copy_only=False)
        known = self._ids(pieces.dictionary.to_pylist())
        size = np.array([len(ids) for ids in known], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        # The ids of all pieces in order: where each piece's ids begin, and a step within.
        length = size[which]
        after = np.cumsum(length)
        step = np.arange(after[-1]) - np.repeat(after - length, length)
        ids = flat[np.repeat((np.cumsum(size) - size)[which], length) + step]
        bounds = np.concatenate(([0], after))[np.searchsorted(offsets, np.concatenate(([0], ends)))]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """One array of ids (uint32) per text, whole texts some megabytes at a time."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            data = text.encode()
            if self.added is not None and self.added.search(data):
                yield from self._slice(held)
                held, size = [], 0
                whole = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
                yield np.array(whole.ids, dtype="<u4")
                continue
            held.append(data)
            size += len(data)
            if size >= SLICE_BYTES:
                yield from self._slice(held)
                held, size = [], 0
        yield from self._slice(held)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, with the library's ids."""
    return per_worker(f"encoder {path}", lambda: Encoder(path, names_are_text=False))
