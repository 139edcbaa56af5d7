"""Operators over many rows against brute force."""

import bisect
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from labtables.llm import jaccard_join, mixing, nearest, packing
from labtables.llm import queries as llm_queries


def brute_links(docs):
    sets = []
    for doc, text in docs:
        words = text.split()
        size = min(5, max(len(words), 1))
        sets.append((doc, frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))))
    n = len(sets)
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    group = {}
    for i in range(n):
        if sets[i][0] is not None:
            group[find(i)] = min(group.get(find(i), 1 << 60), sets[i][0])
    return Counter((sets[i][0], group.get(find(i)), links[i]) for i in range(n))


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_join(spark, both, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base = [f"t{k}" for k in range(150)]
    more = []
    for k in range(40):
        words = [*base]
        for at in range(k % 6):
            words[(k * 7 + at * 29) % 150] = f"u{k}"
        more.append((1000 + k, " ".join(words)))
    docs = both.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = jaccard_join.near_duplicates(docs)
    given = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found.collect()) == brute_links(given)
    kept = jaccard_join.one_of_each_group(docs).collect()
    assert len(kept) == len({r["class_id"] for r in found.collect()})


def test_unlinked_documents_stay_whatever_their_ids(spark):
    def text(seed):
        return " ".join(f"{seed}w{k}" for k in range(40))

    near = text("g").replace("gw39", "other")
    rows = [(None, text(seed)) for seed in "abcdef"] + [(None, text("a")), (None, text("g")), (None, near)]
    rows += [(5, text("h")), (5, text("i")), (5, text("i")), (-1, text("j")), (9, text("k")), (None, text("k"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.near_duplicates(docs).collect()
    assert len({r["group_id"] for r in found}) == 11
    assert sum(r["text_links"] for r in found) == 2  # of "g" and its near copy
    kept = Counter((r["doc_id"], r["text"][0]) for r in jaccard_join.one_of_each_group(docs).collect())
    expected = [(None, seed) for seed in "abcdefg"] + [(5, "h"), (5, "i"), (-1, "j"), (9, "k")]
    assert kept == Counter(expected)


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_matches()
    rng = np.random.default_rng(1)
    steps = np.arange(1, len(least) + 1) * jaccard_join.STEP
    met = (rng.random((200_000, jaccard_join.STEP * len(least))) < 0.8).cumsum(axis=1)[:, steps - 1]
    assert (met < np.array(least)).any(axis=1).mean() < 1e-4
    assert least[-1] > 40  # and drops those far below


def lasting(weights, slots):
    """Blocks of each source that last for so many slots, and some more."""
    total = sum(weights.values())
    return {name: int(slots * w / total) + 2 for name, w in weights.items()}


@pytest.mark.parametrize(
    "weights",
    [[1, 1, 1], [5, 3, 1, 0.2], [0.9, 0.05, 0.05], [1], [n**0.5 for n in (2, 3, 5, 7, 11, 13, 17, 1900)], [1e6, 1, 3**0.5]],
)
def test_schedule_deviates_by_less_than_a_block(weights):
    """From the weights as given, over 200,000 slots."""
    weights = {f"s{k}": w for k, w in enumerate(weights)}
    blocks = lasting(weights, 200_000)
    plan = [row for row in mixing.schedule(weights, blocks) if row[2] < 200_000]
    assert [slot for _, _, slot in plan] == list(range(200_000))
    names = sorted(weights)
    shares = np.array([weights[n] for n in names]) / sum(weights.values())
    ran = np.zeros((len(plan), len(names)))
    ran[np.arange(len(plan)), [names.index(source) for source, _, _ in plan]] = 1
    done = ran.cumsum(axis=0)
    assert np.abs(done - np.outer(np.arange(1, len(plan) + 1), shares)).max() < 1 + 1e-6
    for k, name in enumerate(names):
        assert [j for source, j, _ in plan if source == name] == list(range(int(done[-1, k])))


def brute_schedule(weights, blocks):
    """Slot by slot over all blocks."""
    total = sum(Fraction(w) for w in weights.values())
    left = []
    for name, n in blocks.items():
        share = Fraction(weights[name]) / total
        left += [(math.ceil((j + 1) / share), math.floor(j / share), name, j) for j in range(n)]
    out, slot = [], 0
    while left:
        released = [b for b in left if b[1] <= slot]
        if released:
            first = min(released)
            left.remove(first)
            out.append((first[2], first[3], slot))
        slot += 1
    return out


def test_schedule_against_a_search_in_every_slot():
    rng = np.random.default_rng(7)
    for _ in range(15):
        names = [f"s{k}" for k in range(rng.integers(1, 6))]
        weights = {n: float(w) for n, w in zip(names, rng.random(len(names)) + 0.05, strict=True)}
        blocks = {n: int(rng.integers(1, 30)) for n in names}
        assert mixing.schedule(weights, blocks) == brute_schedule(weights, blocks)


def test_weights_of_all_sources_are_above_zero():
    names = ["a", "b", "c", None]
    assert mixing.usable_weights({"a": 3, "b": 2, "x": 9}, names) == {"a": 3, "b": 2, "c": 2, None: 2}
    assert mixing.usable_weights({"a": 0, "b": -1}, names) == dict.fromkeys(names, 1)
    assert mixing.usable_weights({"a": 1.0, "b": 1e-30}, ["a", "b"])["b"] == mixing.LEAST_WEIGHT
    assert mixing.block_chars(1000) == mixing.BLOCK_CHARS
    assert -(-(10**14) // mixing.block_chars(10**14)) <= mixing.MOST_BLOCKS


def test_slots_of_documents_against_the_search(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 50)
    rows = [(k, "x" * (k % 37), [None, "a", "b", "c"][k % 7 % 4]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {None: 2**0.5, "a": 3**0.5, "b": 0.3, "c": 1.0}
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += max(len(text), 1)
    blocks = {n: -(-sizes[n] // 50) for n in ("a", "b", "c")} | {"~": -(-sizes[None] // 50)}
    named = {n or "~": w for n, w in weights.items()}
    expected = {(s, j): slot for s, j, slot in brute_schedule(named, blocks)}
    found = mixing.mix(docs, weights).select("source", "__mix.*").collect()
    assert len(found) == 400
    assert all(expected[r["source"] or "~", r["block"]] == r["slot"] for r in found)


def test_mixing(odd, real, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    for docs in (odd, real):
        out = mixing.mix(docs, {"s1": 3.0, "src1": 2.0})
        plain = out.drop("__mix")
        assert plain.columns == docs.columns
        assert Counter(map(str, plain.collect())) == Counter(map(str, docs.collect()))
        rows = out.select("source", "__mix.*", F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).alias("n")).collect()
        by_source = {}
        for r in rows:
            by_source.setdefault(r["source"], []).append(r)
        for found in by_source.values():
            at = 0
            for r in sorted(found, key=lambda r: (r["place"], r["n"])):
                assert r["place"] == at and r["block"] == at // 2000
                at += r["n"]
        # One block per slot.
        assert len({(r["source"], r["block"]) for r in rows}) == len({r["slot"] for r in rows})


def brute_nearest(vectors, top):
    ids, points = zip(*vectors, strict=True)
    ids, points = np.array(ids), np.array(points, dtype=float)
    out = {}
    for query in ids[ids % 20 == 0]:
        own = points[ids == query][0]
        scores = (points * own).cumsum(axis=1)[:, -1]
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != query][:top]
        out[int(query)] = [(int(ids[k]), float(scores[k])) for k in order]
    return out


def test_nearest_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet".replace("sf0.001", "sf0.1"))
    expected = brute_nearest([(r["vec_id"], r["embedding"]) for r in table.collect()], 20)
    found = {}
    rows = nearest.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(expected)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 20 * len(expected)
    for query, near in found.items():
        exact = dict(expected[query])
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in near if i in exact)


def test_nearest_recall_on_many_rows(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(10, 32))[rng.integers(0, 10, 20_000)] * 0.3 + rng.normal(size=(20_000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    table = spark.createDataFrame(
        [(k, p) for k, p in enumerate(points.tolist())], "vec_id long, embedding array<double>"
    )
    found = {}
    for r in nearest.search(table, F.col("vec_id") % 400 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(found) == 50
    hits = 0
    for query, near in found.items():
        scores = points @ points[query]
        scores[query] = -2
        hits += len(near & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.99 * 20 * len(found)


def test_nearest_leaves_out_entries_that_cannot_matter():
    held = {0: 5, 1: 5, 2: 5, 3: 5}
    assert nearest.walk(np.array([1.0, 0.2]), np.array([0.5, 0.1]), held, 0.7) == [0, 1, 2]
    assert nearest.bundles({0: 3000, 1: 1000, 2: 200, 24: 9000, 25: 1}, 24) == {0: 0, 1: 0, 2: 2, 24: 24, 25: 25}


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, float(k % 3), 0.5]) for k in range(30)]
    rows += [(40, None), (60, []), (80, [0.0, 0.0, 0.0]), (100, [nan, 1.0, 1.0]), (120, [inf, 1.0, 1.0])]
    rows += [(140, [None, 1.0, 1.0]), (160, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(
        [(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, entry int, rank string"
    )
    found = nearest.search(table, F.col("vec_id") % 20 == 0, top=5).orderBy("query_id", "rank").collect()
    expected = brute_nearest([(k, [1.0, float(k % 3), 0.5]) for k in range(30)], 5)
    assert [(r["query_id"], r["vec_id"]) for r in found] == [
        (q, i) for q, near in sorted(expected.items()) for i, _ in near
    ]
    assert nearest.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def write_table(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in llm_queries.QUERIES if n not in ("op6_nearest", "op11_whitening")])
def test_queries_take_odd_and_empty_tables(spark, odd, empty, tmp_path, name):
    query = llm_queries.QUERIES[name]
    n = query(spark, write_table(odd, tmp_path / "odd")).count()
    assert n >= odd.count()
    assert query(spark, write_table(empty, tmp_path / "empty")).count() == 0


def test_pipeline(spark, odd, empty, real, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty), ("real", real)):
        held, folder = docs, tmp_path / name
        kept = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, held, str(folder))
            out.write.parquet(f"{folder}/{k}")
            held = spark.read.parquet(f"{folder}/{k}")
            if k < 4:
                assert held.columns == docs.columns
                kept.append(held.count())
        assert kept[1] == kept[2] == kept[3]
        assert held.select("doc_id", "start").count() >= kept[3]
        if name == "real":
            assert kept[0] == docs.count()
            given = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert kept[1] == len({group for _, group, _ in brute_links(given)})
        if name == "odd":
            # Without letters: two nulls, one empty, one blank and one of marks and digits.
            assert kept[0] == docs.count() - 5
    whole = corpus_pipeline.run(spark, write_table(real, tmp_path / "run"))
    assert whole.count() >= 1


def test_pipeline_works_out_languages_once(spark, real):
    """A filter on the result must not bring a second Python worker for the same texts."""
    plan = corpus_pipeline.language(spark, real, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython [") == 1


@pytest.mark.parametrize("shard", [200_000, 300])
def test_sequences_follow_the_mixture(spark, monkeypatch, shard):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(packing, "RUN_PIECES", 100)
    monkeypatch.setattr(packing, "SHARD_PIECES", shard)
    rows = [(k, " ".join(f"{k % 7} word{k}" for _ in range(12)), "big" if k % 10 else "small") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = mixing.tempered(mixing.source_sizes(docs))
    share = weights["small"] / sum(weights.values())  # a quarter, of a tenth of the texts
    slots = {r["doc_id"]: r["slot"] for r in mixing.mix(docs, weights).select("doc_id", "__mix.slot").collect()}
    found = corpus_pipeline.pack(spark, corpus_pipeline.mix_sources(spark, docs, ""), "").collect()
    assert {r["doc_id"]: r["slot"] for r in found} == slots
    assert len(found) == len({(r["doc_id"], r["piece"]) for r in found})
    assert {r["doc_id"] for r in found} == set(range(1500))
    order = sorted(found, key=lambda r: r["sequence_id"])
    # As long as the small source lasts, every prefix of sequences has its share of it.
    for n in (200, 300, 400, 500):
        taken = sum(r["length"] for r in order[:n] if r["source"] == "small")
        assert abs(taken / sum(r["length"] for r in order[:n]) - share) < 0.08, n
    middle = [r["slot"] for r in order]
    assert np.corrcoef(middle, np.arange(len(middle)))[0, 1] > 0.99


def lengths_to_pack(name):
    rng = np.random.default_rng(3)
    return {
        "two sizes": lambda: np.repeat([683, 1365], 1000),
        "three sizes": lambda: np.repeat([548, 1000, 1500], 1000),
        "uniform": lambda: rng.integers(1, 2049, 8192),
        "skewed": lambda: np.clip(rng.lognormal(6.2, 0.9, 8192).astype(int) + 1, 1, 2048),
        "middle": lambda: rng.integers(257, 1025, 8192),
        "one size among many": lambda: np.r_[rng.integers(300, 2049, 3000), np.full(3000, 683)],
        "small ones only": lambda: rng.integers(1, 200, 3000),
        "one": lambda: np.array([5]),
    }[name]().astype(np.int64)


def best_fit_decreasing(lengths, capacity):
    """Rooms of the sequences, each length into the fullest that can take it."""
    rooms = []
    for length in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return rooms


@pytest.mark.parametrize(
    "name", ["two sizes", "three sizes", "uniform", "skewed", "middle", "one size among many", "small ones only", "one"]
)
def test_never_more_sequences_than_best_fit_decreasing(name):
    lengths = lengths_to_pack(name)
    sequence, offset = packing.pack_lengths(lengths, 2048)
    used = int(sequence.max()) + 1
    assert used <= len(best_fit_decreasing(lengths, 2048))
    assert name != "two sizes" or used == 1000
    for number in range(used):
        mine = np.flatnonzero(sequence == number)
        mine = mine[np.argsort(offset[mine])]
        ends = np.cumsum(lengths[mine])
        assert ends[-1] <= 2048 and offset[mine].tolist() == [0, *ends[:-1].tolist()]


def test_programme_reaches_the_best_total():
    """Sizes 683 and 1365 fill a sequence; thirds of 682 fill it too."""
    for sizes, demand, best in [([683, 1365], [70, 70], 70), ([682], [99], 33), ([300, 500, 700], [40, 60, 20], 30)]:
        chosen = list(packing.configurations(np.array(sizes), np.array(demand), 2048))
        got = np.zeros(len(sizes))
        for configuration, times in chosen:
            assert sum(sizes[k] for k in configuration) <= 2048
            for k in configuration:
                got[k] += times
        assert (got <= demand).all()
        assert sum(times for _, times in chosen) <= best


@given(st.lists(st.integers(257, 2048), min_size=1, max_size=60), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_programme_always_ends(sizes, times):
    sizes = np.unique(sizes)
    chosen = list(packing.configurations(sizes, np.full(len(sizes), times), 2048))
    used = np.zeros(len(sizes))
    for configuration, often in chosen:
        for k in configuration:
            used[k] += often
    assert (used <= times).all()


def test_mixing_deals_texts_out_once(spark):
    """Slots reach the buckets, so no join shuffles the documents again, whatever is broadcast."""
    docs = spark.createDataFrame([(k, "x" * 50, f"s{k % 3}") for k in range(90)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.mix(docs, {"s0": 1.0, "s1": 2.0, "s2": 1.0})
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert out.count() == 90
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Exchanges of documents: those with nothing but row-wise steps between them and the scan, or above such.
    depth = [line.index(line.lstrip(" :+-")) for line in lines]
    carried = [
        k for k, line in enumerate(lines)
        if "Exchange hashpartitioning" in line
        and any("AS row#" in lines[j] for j in range(k + 1, len(lines)) if all(depth[i] > depth[k] for i in range(k + 1, j + 1)))
    ]
    assert len(carried) == 1
