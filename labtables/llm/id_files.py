"""Token ids in binary files: one zstandard frame per document, one shared dictionary.

A file holds, in this order: 8 magic bytes, the header's length (uint32), the header (JSON:
SHA-256 of the dictionary, bytes per id, number of documents and of ids), the index (for
each document: doc_id int64, 1 if it is null else 0 (uint8), number of ids int64, end of
its frame int64), and the frames.  A reader that has the dictionary gets one document by
its index entry and its frame alone.  Numbers are little-endian.

Files are cut by ranges of doc_id and numbered in that order.  A task writes a file under
a name of its own and then moves it to its place, so a task that runs again, after a lost
executor, replaces it by the same bytes.

Defined cases: a null text is the empty text (only the end id); repeated doc_ids are
separate documents, ordered by a hash of their text; null doc_ids come first; an empty
table has no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.llm._common import letters_hash, parts_for, texts
from labtables.llm._tokens import encoder

MAGIC = b"LTIDS\x00\x01\n"
#: Frames in one file; a task starts another file beyond it.
FILE_BYTES = 32 << 20
#: Documents that the dictionary is trained on, about, and what each gives at most.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 15, 112_640
LEVEL = 3

_INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("n_ids", "<i8"), ("end", "<i8")])


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def deserialize(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if width == 2 else "<u4").astype("<u4")


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for serialized id arrays; the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def pack_file(entries: list[tuple[int | None, int, bytes]], width: int, digest: str) -> bytes:
    """One file's bytes from (doc_id, number of ids, frame)."""
    index = np.zeros(len(entries), dtype=_INDEX)
    index["doc_id"] = [0 if doc is None else doc for doc, _, _ in entries]
    index["no_id"] = [doc is None for doc, _, _ in entries]
    index["n_ids"] = [n for _, n, _ in entries]
    index["end"] = np.cumsum([len(frame) for _, _, frame in entries])
    header = json.dumps(
        {
            "dictionary": digest,
            "width": width,
            "documents": len(entries),
            "ids": int(index["n_ids"].sum()),
        }
    ).encode()
    return b"".join(
        [MAGIC, struct.pack("<I", len(header)), header, index.tobytes(), *(e[2] for e in entries)]
    )


class IdFile:
    """Reads one file's bytes; ``ids(i)`` touches only the frame of document i."""

    def __init__(self, content: bytes, dictionary: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        size = struct.unpack_from("<I", content, 8)[0]
        self.header = json.loads(content[12 : 12 + size])
        if self.header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the file was written with another dictionary")
        at = 12 + size
        self.index = np.frombuffer(content, _INDEX, self.header["documents"], at)
        self.frames = memoryview(content)[at + self.index.nbytes :]
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> np.ndarray:
        begin = int(self.index["end"][i - 1]) if i else 0
        n = int(self.index["n_ids"][i])
        frame = self.frames[begin : int(self.index["end"][i])]
        width = self.header["width"]
        return deserialize(self.reader.decompress(frame, max_output_size=n * width), width)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def sample_texts(docs: DataFrame) -> list[str]:
    """About SAMPLE_DOCUMENTS texts, spread over the table by a hash of their doc_id."""
    rows = docs.count()
    keep = min(1.0, 2 * SAMPLE_DOCUMENTS / max(rows, 1))
    found = texts(docs).where(F.pmod(letters_hash("doc_id"), F.lit(1 << 20)) < keep * (1 << 20))
    cut = F.substring("text", 1, SAMPLE_BYTES)  # only what the dictionary learns from
    return [row[0] for row in found.select(cut).limit(2 * SAMPLE_DOCUMENTS).collect()]


def write_ids(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, width: int = 2
) -> tuple[bytes, list[tuple[str, int]]]:
    """Write every document's ids in ascending doc_id order below ``folder``.

    Returns the dictionary and (file name, ids in it) in that order, a row per file.
    ``width`` 2 holds vocabularies up to 65,536 ids.  The folder must be one that all
    executors share.
    """
    spark = docs.sparkSession
    learner = encoder(vocabulary)
    sample = [serialize(ids, width)[:SAMPLE_BYTES] for ids in learner.encode(sample_texts(docs))]
    dictionary = train_dictionary([one for one in sample if one]) if any(sample) else b""
    digest = hashlib.sha256(dictionary).hexdigest()
    ordered = (
        texts(docs)
        .withColumn("tie", letters_hash("text"))
        .repartitionByRange(parts_for(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    task = _write_task(folder, vocabulary, end_id, width, dictionary, digest)
    written = ordered.mapInPandas(task, "name string, n_ids long").collect()
    return dictionary, sorted((row.name, row.n_ids) for row in written)


def _write_task(
    folder: str, vocabulary: str, end_id: int, width: int, dictionary: bytes, digest: str
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        entries: list[tuple[int | None, int, bytes]] = []
        size = number = 0

        def close() -> pd.DataFrame:
            name = f"part-{part:07d}-{number:05d}.ids"
            own = f"{root}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(pack_file(entries, width, digest))
            store.move(own, f"{root}/{name}")
            return pd.DataFrame({"name": [name], "n_ids": [sum(e[1] for e in entries)]})

        for batch in batches:
            for doc, ids in zip(batch["doc_id"], encoder(vocabulary).encode(batch["text"]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                frame = writer.compress(serialize(ids, width))
                entries.append((None if pd.isna(doc) else int(doc), len(ids), frame))
                size += len(frame)
                if size >= FILE_BYTES:
                    yield close()
                    entries, size, number = [], 0, number + 1
        if entries:
            yield close()

    return write


def read_ids(
    spark, folder: str, dictionary: bytes, files: list[tuple[str, int]]
) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    starts, total = {}, 0
    for name, n_ids in files:
        starts[name] = total
        total += n_ids

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = IdFile(content, dictionary)
                n = held.index["n_ids"]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(held.index["doc_id"], dtype="Int64").copy()
                        if not held.index["no_id"].any()
                        else pd.Series(held.index["doc_id"]).astype("Int64").mask(
                            held.index["no_id"] == 1
                        ),
                        "start": starts[path.rpartition("/")[2]] + np.cumsum(n) - n,
                        "n_tokens": n,
                        "ids_crc32": [zlib.crc32(held.ids(i).tobytes()) for i in range(len(held))],
                    }
                )

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder)
    return found.select("path", "content").mapInPandas(read, schema)
