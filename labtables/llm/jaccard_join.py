"""N-gram Jaccard join with Bayesian candidate pruning, and groups of near duplicates.

A document is its set of shingles of SHINGLE consecutive words; a shorter one is a single
shingle.  Two documents are linked if their sets' Jaccard similarity is THRESHOLD or more.

1. Equal sets are one class; everything below works on one representative of each class.
2. MinHash values in BANDS bands of ROWS: classes that share a band's values are candidates
   (a pair at the threshold is missed with probability (1 - 0.8^4)^24, about 3 in a million).
3. Candidates are compared in blocks.  A block is up to BLOCK classes with the same label (the
   smallest class reached over shared bands in LABEL_ROUNDS rounds), so that groups of near
   copies lie together, and two blocks meet if any of their classes share a band.
4. In a meeting of two blocks the candidates' MinHash values are compared STEP at a time; a pair
   goes as soon as the posterior probability (uniform prior) that it reaches the threshold falls
   below TOLERANCE.  The rest are verified exactly on their sets.
5. A meeting returns a row per class: its number of links and one link to a class of its local
   group, never its pairs.  Links are summed, groups joined by smallest-label propagation.

Texts are read for the signatures and again only for representatives that share a band.  A large
group of near copies with different texts takes work quadratic in its size, as the number of its
links asks for, but in independent meetings of bounded size.

Defined cases: a null text is the empty text; texts without words have the empty set and are one
class, without links to others; repeated rows are copies; a null doc_id is larger than any other
when the smallest is taken, and a group of only such ones has a null class_id; group_id tells all
groups apart, also those and ones that share a doc_id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.llm._common import give_back, letters_hash, per_worker, texts
from labtables.llm._words import mixed, run_hashes, word_hashes, word_spans
from labtables.session import scratch_dir

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 16
TOLERANCE = 1e-7
BLOCK = 256
LABEL_ROUNDS = 3

_HASHES = BANDS * ROWS
_SEEDS = mixed(np.arange(1, _HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _SEEDS | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    data = text.encode()
    words = word_hashes(data, *word_spans(data))
    return np.unique(run_hashes(words, min(SHINGLE, max(len(words), 1))))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits); all ones for the empty set."""
    out = np.full(_HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(found), 4096):
        part = found[start : start + 4096, None] * _ODD[None, :] + _SEEDS[None, :]
        # The high half of a product depends on all bits below it.
        out = np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64) * _SEEDS[0]
    for k in range(ROWS):
        keys = mixed(keys ^ (values[k::ROWS][:BANDS].astype(np.uint64) + _SEEDS[k]))
    return keys.view(np.int64)


def set_key(found: np.ndarray) -> int:
    """64 bits that stand for a set."""
    x = mixed(found + _SEEDS[1]).sum(dtype=np.uint64) + np.uint64(len(found))
    return int(mixed(np.array([x]))[0].view(np.int64))


def least_matches() -> tuple[int, ...]:
    """After STEP, 2 STEP, ... values: the fewest matches with which a pair goes on."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, _HASHES + 1, STEP):
        least = 0
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= THRESHOLD].sum() / density.sum() >= TOLERANCE:
                least = m
                break
        out.append(least)
    return tuple(out)


def candidates(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures that share a band and survive the incremental comparison."""
    shared = np.zeros((len(left), len(right)), dtype=bool)
    one = np.stack([band_keys(s) for s in left])
    two = one if same else np.stack([band_keys(s) for s in right])
    for k in range(BANDS):
        shared |= one[:, k][:, None] == two[:, k][None, :]
    if same:
        shared &= np.tri(len(left), dtype=bool, k=-1).T
    i, j = np.nonzero(shared)
    met = np.zeros(len(i), dtype=np.int64)
    for step, least in enumerate(per_worker("least matches", least_matches)):
        part = slice(step * STEP, (step + 1) * STEP)
        met += (left[i, part] == right[j, part]).sum(axis=1)
        go = met >= least
        i, j, met = i[go], j[go], met[go]
    return i, j


def verify(
    sets: list[np.ndarray], others: list[np.ndarray], i: np.ndarray, j: np.ndarray
) -> np.ndarray:
    """Which pairs really reach the threshold, from the whole sets."""
    if len(i) <= 400:
        common = np.array(
            [len(np.intersect1d(sets[a], others[b], assume_unique=True)) for a, b in zip(i, j, strict=True)]
        )
    else:
        # Shared counts of all pairs of the two blocks, some thousand shingles at a time.
        every, times = np.unique(np.concatenate([*sets, *others]), return_counts=True)
        every = every[times > 1]
        counts = np.zeros((len(sets), len(others)), dtype=np.float32)
        rows = [np.searchsorted(every, s[np.isin(s, every, assume_unique=True)]) for s in sets]
        columns = [np.searchsorted(every, s[np.isin(s, every, assume_unique=True)]) for s in others]
        for start in range(0, len(every), 8192):
            width = min(8192, len(every) - start)

            def block(found: list[np.ndarray], start: int = start, width: int = width) -> np.ndarray:
                out = np.zeros((len(found), width), dtype=np.float32)
                for row, one in enumerate(found):
                    out[row, one[(one >= start) & (one < start + width)] - start] = 1
                return out

            counts += block(rows) @ block(columns).T
        common = counts[i, j].astype(np.int64)
    sizes = np.array([len(s) for s in sets])[i] + np.array([len(s) for s in others])[j]
    # common / (sizes - common) >= 0.8, in whole numbers
    return 9 * common >= 4 * sizes if THRESHOLD == 0.8 else common >= THRESHOLD * (sizes - common)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, row, text in zip(batch["doc_id"], batch["row_key"], batch["text"], strict=True):
            found = shingles(text)
            rows.append((doc, row, set_key(found), band_keys(signature(found)) if len(found) else []))
        out = pd.DataFrame(rows, columns=["doc_id", "row_key", "cls", "bands"])
        yield out.astype({"doc_id": "Int64"})
        give_back()


def _meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links inside one meeting: per class their number, and one class of its local group."""
    # A class comes once, whichever rows of it were read.
    rows = rows.drop_duplicates(["cls", "side"]).sort_values(["side", "cls"])
    sets = [shingles(text) for text in rows["text"]]
    values = np.stack([signature(s) for s in sets])
    cls, copies = rows["cls"].to_numpy(), rows["copies"].to_numpy()
    side = rows["side"].to_numpy()
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1)
    same = not len(second)
    second = first if same else second
    i, j = candidates(values[first], values[second], same)
    real = verify([sets[k] for k in first], [sets[k] for k in second], i, j)
    a, b = first[i[real]], second[j[real]]
    links = np.bincount(a, minlength=len(cls)) + np.bincount(b, minlength=len(cls))
    weighed = np.bincount(a, copies[b], len(cls)) + np.bincount(b, copies[a], len(cls))
    root = np.arange(len(cls))
    while True:  # smallest label among linked ones, until nothing changes
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    use = links > 0
    return pd.DataFrame(
        {
            "cls": cls[use],
            "other": cls[root[use]],
            "links": links[use].astype(np.int64),
            "documents": weighed[use].astype(np.int64),
        }
    )


def _labels(shared: DataFrame) -> DataFrame:
    """cls, label: classes that share bands get the same label as far as a few rounds reach."""
    label = shared.select("cls", F.col("cls").alias("label")).distinct()
    for _ in range(LABEL_ROUNDS):
        low = shared.join(label, "cls").groupBy("key").agg(F.min("label").alias("label"))
        label = shared.join(low, "key").groupBy("cls").agg(F.min("label").alias("label"))
    return label


def groups(edges: DataFrame) -> DataFrame:
    """cls, grp: connected groups of (cls, other), each named by one of its classes.

    Every round gives each class the smallest name among its neighbours' and then that name's
    own name; local groups were joined before, so a few rounds do.  Each round is written, which
    cuts the lineage.
    """
    spark = edges.sparkSession
    both = edges.select("cls", "other").union(edges.select("other", "cls")).distinct()
    folder = scratch_dir(spark, "groups")
    both.write.parquet(f"{folder}-edges")
    both = spark.read.parquet(f"{folder}-edges")
    names = both.groupBy("cls").agg(F.least(F.min("other"), F.first("cls")).alias("grp"))
    for turn in range(1000):
        names.write.parquet(f"{folder}-{turn}")
        names = spark.read.parquet(f"{folder}-{turn}")
        low = (
            both.join(names.select(F.col("cls").alias("other"), "grp"), "other")
            .groupBy("cls")
            .agg(F.min("grp").alias("low"))
        )
        near = names.join(low, "cls").select("cls", "grp", F.least("grp", "low").alias("low"))
        up = names.select(F.col("cls").alias("low"), F.col("grp").alias("up"))
        jumped = near.join(up, "low", "left").select(
            "cls", F.col("grp").alias("old"), F.least("low", "up").alias("grp")
        )
        jumped.write.parquet(f"{folder}-{turn}-next")
        jumped = spark.read.parquet(f"{folder}-{turn}-next")
        if not jumped.where(F.col("grp") != F.col("old")).limit(1).count():
            break
        names = jumped.select("cls", "grp")
    return names.select("cls", "grp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, group_id, class_id, copies, text_links, n_links, row_key.

    group_id names its group (of documents linked over any number of steps) by the smallest
    hash of its sets, class_id is the group's smallest doc_id, copies the number of documents
    with the same set, text_links the number of other sets linked to it, n_links the number of
    other documents linked to it, copies among them; row_key is ``row_key(docs)``, to find the row again.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "jaccard")
    read = texts(docs)
    read.withColumn("row_key", row_key()).mapInPandas(
        _signatures, "doc_id long, row_key long, cls long, bands array<long>"
    ).write.parquet(f"{folder}-signatures")
    signed = spark.read.parquet(f"{folder}-signatures")
    classes = signed.groupBy("cls").agg(
        F.min("doc_id").alias("first_id"),
        F.min("row_key").alias("first_key"),
        F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands"),
    )
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    keyed.join(often, "key").write.parquet(f"{folder}-shared")
    shared = spark.read.parquet(f"{folder}-shared")

    label = _labels(shared)
    sizes = label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    blocks = label.join(sizes, "label").select(
        "cls", letters_hash("label", F.pmod(letters_hash("cls"), F.col("cuts"))).alias("block")
    )
    blocks.write.parquet(f"{folder}-blocks")
    blocks = spark.read.parquet(f"{folder}-blocks")
    meeting = shared.join(blocks, "cls").groupBy("key", "block").count()
    one = meeting.select("key", F.col("block").alias("a"), "count")
    two = meeting.select("key", F.col("block").alias("b"))
    met = (
        one.join(two, "key")
        .where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("count") > 1)))
        .select("a", "b")
        .distinct()
    )
    sides = met.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).union(
        met.where("a != b").select("a", "b", F.lit(1), "b")
    )

    # Texts of the representatives that meet others, found by a key that rows of other texts
    # do not share, whatever their ids.
    chosen = blocks.join(classes, "cls").select(F.col("first_key").alias("row_key"), "cls", "block", "copies")
    given = docs.select(row_key().alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    having = given.join(chosen, "row_key").select("cls", "block", "copies", "text")
    found = (
        having.join(sides, "block")
        .select("a", "b", "side", "cls", "copies", "text")
        .groupBy("a", "b")
        .applyInPandas(_meet, "cls long, other long, links long, documents long")
    )
    found.write.parquet(f"{folder}-links")
    found = spark.read.parquet(f"{folder}-links")

    links = found.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    named = groups(found)
    of_class = (
        classes.select("cls", "first_id", "copies")
        .join(links, "cls", "left")
        .join(named, "cls", "left")
        .withColumn("grp", F.coalesce("grp", "cls"))
    )
    smallest = of_class.groupBy("grp").agg(F.min("first_id").alias("class_id"))
    of_class = of_class.join(smallest, "grp").select(
        "cls",
        F.col("grp").alias("group_id"),
        "class_id",
        "copies",
        F.coalesce("links", F.lit(0)).alias("text_links"),
        (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return signed.select("doc_id", "row_key", "cls").join(of_class, "cls").drop("cls")


def row_key() -> Column:
    """What tells rows apart: doc_id and text (null as empty)."""
    return letters_hash("doc_id", F.coalesce("text", F.lit("")))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one stays in each group: that of the smallest doc_id."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = (
        near_duplicates(docs)
        .groupBy("group_id")
        .agg(F.min(place).alias("first"))
        .select("first.row_key")
    )
    rows = docs.select(
        row_key().alias("row_key"), F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")
    )
    # Rows repeated as a whole have one key; any of them will do.
    one = rows.join(first, "row_key").groupBy("row_key").agg(F.first("row").alias("row"))
    return one.select(*[F.col("row")[n].alias(n) for n in docs.columns])
