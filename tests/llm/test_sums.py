"""Whitening, Merkle proofs and token counts against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from labtables.llm import merkle, token_counts, whitening
from labtables.llm import queries as llm_queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_components(vectors, top=8):
    x = np.floor(np.array(vectors, dtype=float) * 1024).astype(np.int64) + 100_000
    centred = x - x.sum(axis=0) / len(x)
    covariance = centred.T @ centred / len(x)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:top], directions[:, ::-1][:, :top]
    deviation = [sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
    return centred @ directions / np.sqrt(values), values / covariance.trace(), deviation


def check_components(table, ids, vectors, top=8):
    white, shares, deviation = brute_components(vectors, top)
    at = {i: k for k, i in enumerate(ids)}
    found = np.full(white.shape, np.nan)
    rows = whitening.whiten(table, top).collect()
    for r in rows:
        k = at[r["vec_id"]]
        found[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(ids)
        assert r["deviation"] == (deviation[k] if deviation[k] < 1 << 63 else None)
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert len(rows) == white.size
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - signs * white).max() < 1e-8


def test_whitening_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.collect()
    check_components(table, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(200, 5)) * [9, 5, 3, 2, 1]
    points[10] = [1e5, -3e4, 0.25, 7, 1]  # far out
    points[11] = points[12]
    nan, inf = float("nan"), float("inf")
    rows = [(k, p) for k, p in enumerate(points.tolist())]
    odd = [(900, None), (901, []), (902, [nan, 1.0, 1.0]), (903, [1.0, inf, 1.0]), (904, [1.0, None, 1.0])]
    odd += [(905, [1.0, 2.0]), (906, [1e30] * 5), (907, [1.0])]
    table = spark.createDataFrame(
        [(i, v, 0, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, component int, id string"
    ).repartition(3)
    check_components(table, list(range(200)), points, top=4)
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id = 3")).count() == 0
    copies = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whiten(copies).count() == 0
    nulls = table.where("vec_id < 50").withColumn("vec_id", F.when(F.col("vec_id") > 9, F.col("vec_id")))
    assert whitening.whiten(nulls, 2).where("vec_id is null").count() == 2 * 10
    huge = spark.createDataFrame(
        [(k, [k * 1e9, k % 3.0]) for k in range(8)], "vec_id long, embedding array<double>"
    )
    assert {r["deviation"] for r in whitening.whiten(huge, 1).collect()} >= {None}


class Dense(whitening.Rows):
    """Rows of a matrix in memory, for the walk alone."""

    def __init__(self, x):
        self.x, self.n, self.means = x, len(x), x.mean(axis=0)
        self.passes = 0

    def total(self, part, whole=False):
        self.passes += 1
        return part(self.x)


def test_walk_finds_equal_deviations_and_ends_early():
    rng = np.random.default_rng(4)
    own = np.linalg.qr(rng.normal(size=(400, 120)) - 0)[0]
    own = np.linalg.qr(own - own.mean(axis=0))[0]
    turn = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    values = np.concatenate(([50.0, 50.0, 50.0, 40.0, 30.0, 20.0], 5 * 0.8 ** np.arange(114)))
    rows = Dense(own * values @ turn)
    components, found = whitening.Bidiagonal(rows, 6).run()
    assert np.allclose(found, values[:6], rtol=1e-12)
    assert np.allclose(components @ components.T, np.eye(6), atol=1e-12)
    kept = turn[:6]
    assert np.allclose(np.abs(np.linalg.det(components[:3] @ kept[:3].T)), 1)
    assert rows.passes < 120
    # Fewer directions than dimensions.
    flat = Dense(rng.normal(size=(50, 3)) @ rng.normal(size=(3, 10)))
    components, found = whitening.Bidiagonal(flat, 8).run()
    exact = np.linalg.svd(flat.x - flat.means)[1]
    assert len(found) == 3 and np.allclose(found, exact[:3], rtol=1e-12)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fanout):
    """Root and each leaf's siblings in order."""
    proofs, places, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, own in enumerate(places):
            run = own - own % fanout
            proofs[k] += level[run:own] + level[own + 1 : run + fanout]
            places[k] = own // fanout
        level = [h(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], proofs


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows, fanout=2):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["doc_id"], h(*[field(r[f]) for f in FIELDS])))
    trees = []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        ordered = sorted(by_lang[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((ordered, *brute_tree([leaf for _, leaf in ordered], fanout)))
    if not trees:
        return []
    root, above = brute_tree([top for _, top, _ in trees], fanout)
    return sorted(
        (doc if doc is not None else -1, leaf, top, root, "".join(proof + rest))
        for (ordered, top, proofs), rest in zip(trees, above, strict=True)
        for (doc, leaf), proof in zip(ordered, proofs, strict=True)
    )


@pytest.mark.parametrize(("fanout", "block"), [(2, 4096), (2, 4), (3, 9), (4, 2)])
def test_manifest(spark, both, fanout, block, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", block)
    monkeypatch.setattr(merkle, "ROUNDS_WRITTEN", 2)
    docs = both.withColumn("tree", F.lit("x")).withColumn("proof", F.lit(1))
    found = merkle.manifest(docs, FIELDS, "lang", "doc_id", keep=["tree"], fanout=fanout).withColumn(
        "folded", merkle.folded("leaf", fanout)
    )
    rows = found.collect()
    own = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in rows
    )
    assert own == brute_manifest(docs.collect(), fanout)
    assert all(r["folded"] == r["root"] for r in rows)
    r = rows[0]
    places = ((r["leaf_index"], r["n_leaves"]), (r["tree_index"], r["n_trees"]))
    assert merkle.fold("0" * 64, r["proof"], places, fanout) != r["root"]


def test_tampered_documents_are_found(spark, both, tmp_path):
    both.write.parquet(f"{tmp_path}/documents.parquet")
    rows = llm_queries.op12_merkle(spark, str(tmp_path)).collect()
    given = {}
    for doc, leaf, top, root, proof in brute_manifest(both.collect()):
        given.setdefault((doc, leaf), []).append((top, root, h(proof)))
    assert len(rows) == both.count()
    for r in rows:
        doc = -1 if r["doc_id"] is None else r["doc_id"]
        assert (r["subroot"], r["root"], r["proof_sha256"]) in given[doc, r["leaf"]]
        whole = r["doc_id"] is None or zlib.crc32(str(doc).encode()) % 7 != 0
        assert r["verified"] == whole == (r["folded_root"] == r["root"])


def test_one_hot_tree_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 16)
    docs = spark.range(1000).select(
        F.when(F.col("id") > 400, F.col("id")).alias("doc_id"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("lang")
    )
    found = merkle.manifest(docs, ["doc_id", "text"], "lang", "doc_id")
    assert found.select("root", "subroot").distinct().count() == 1
    assert sorted(r[0] for r in found.select("leaf_index").collect()) == list(range(1000))
    assert found.where(merkle.folded("leaf") != F.col("root")).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_of_the_library(spark, both, pieces):
    found = token_counts.count(both, PIECES, limit=1000).collect()
    expected = []
    for r in both.collect():
        n = len(pieces.encode(r["text"] or ""))
        expected.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 1000))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_counts_of_odd_texts(pieces):
    merger = token_counts.Merger(PIECES)
    rng = np.random.default_rng(6)
    bits = ["▁", " ", "a", "e", "t", "th", "ing", "é", "中", "①", "\n", "\t", "0", "\0", "</s>", "<unk>", "\U0001f600", "ﬁ", "."]
    texts = ["".join(rng.choice(bits, rng.integers(0, 80))) for _ in range(2000)]
    texts += ["", " ", " " * 5000, "a" * 5000, "=" * 4097, "ab" * 30_000, "naïve cafés " * 3000, "the " * 20_000]
    assert merger.counts(texts).tolist() == [len(ids) for ids in pieces.encode(texts)]


def test_kept_stretches_change_no_count(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    monkeypatch.setattr(token_counts, "LONG", 5)
    monkeypatch.setattr(token_counts, "SLICE_CHARS", 50)
    merger = token_counts.Merger(PIECES)
    texts = ["one two three four", "", "two threefold one one", "x" * 200, "four three two"] * 5
    for _ in range(2):
        assert merger.counts(texts).tolist() == [len(ids) for ids in pieces.encode(texts)]
    assert len(merger.young) <= 4 and len(merger.old) <= 4


def test_heap_merges_lowest_rank_first():
    merger = token_counts.Merger(PIECES)
    text = " lowering"
    symbols = [*text]
    merged = 0
    while True:
        pairs = [(merger.ranks[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in merger.ranks]
        if not pairs:
            break
        _, k = min(pairs)
        symbols[k : k + 2] = ["".join(symbols[k : k + 2])]
        merged += 1
    assert merger.merges(text) == merged


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):  # noqa: B017 - the library's own error for another format
        token_counts.Merger(public_tokenizers.path("byte_bpe_50k.json"))
