import random

import pytest
from pyspark.sql import functions as F

from labtables.operators import routing as R
from labtables.sources.dimensions import dimension
from labtables.streaming.dispatch import Realms

RULES = [
    R.Rule("10X", "droplet"),
    R.Rule("Plate-3", "plate"),
    R.Rule("MARS", "mars", prefix=True),
    R.Rule("Plate", "first", prefix=True),
    R.Rule("PlateDrop", "second", prefix=True),
]

CASES = {
    "10X": "droplet",
    "10X 3GEX": None,  # no prefix flag
    "Plate-3": "plate",  # exact wins over the prefix
    "MARS-seq": "mars",
    "mars-seq": None,
    " MARS-seq": None,
    "PlateDrop_new": "first",  # first prefix in order
    "Unknown": None,
    "": None,
    None: None,
}


def methods(spark):
    return spark.createDataFrame([(m,) for m in CASES], "method string")


def test_route(spark):
    found = {r.method: r.target for r in R.route(methods(spark), "method", RULES).collect()}
    assert found == {m: t for m, t in CASES.items() if t}


def test_route_by_table_is_the_same(spark):
    registry = dimension(
        spark,
        "pos int, key string, target string, is_prefix boolean",
        [(i, r.key, r.target, r.prefix) for i, r in enumerate(RULES)],
    )
    found = {r.method: r.target for r in R.route_by_table(methods(spark), "method", registry).collect()}
    assert found == {m: t for m, t in CASES.items() if t}


def test_unrouted_counts(spark):
    df = methods(spark).unionByName(spark.createDataFrame([("Unknown",)], "method string"))
    found = {r.method: r.n_rows for r in R.unrouted(df, "method", RULES).collect()}
    assert found["Unknown"] == 2
    assert set(found) == {m for m, t in CASES.items() if t is None}


def test_any_number_of_rules_in_both_forms(spark):
    rules = [R.Rule(f"{i:03d}", f"t{i}", prefix=i % 2 == 0) for i in range(300)]
    registry = dimension(
        spark,
        "pos int, key string, target string, is_prefix boolean",
        [(i, r.key, r.target, r.prefix) for i, r in enumerate(rules)],
    )
    df = spark.createDataFrame([("298x",), ("299",), ("299x",), (None,)], "method string")
    for form in (rules, registry):
        found = {r.method: r.target for r in R.with_target(df, "method", form).collect()}
        assert found == {"298x": "t298", "299": "t299", "299x": None, None: None}
        lost = {r.method: r.n_rows for r in R.unrouted(df, "method", form).collect()}
        assert lost == {"299x": 1, None: 1}


def test_decisions_with_a_long_vocabulary(spark):
    words = [f"w{i}" for i in range(70)]
    decisions = [R.Decision("m", tuple(words), {"to": "all"}), R.Decision("m", ("w69",), {"to": "one"})]
    rows = [("a", w) for w in words] + [("b", "w69"), ("c", "w69"), ("c", "other")]
    df = spark.createDataFrame(rows, "k string, f string")
    groups = R.feature_sets(df, ["k"], "f", decisions).withColumn("m", F.lit("m"))
    found = {r.k: r.to for r in R.match_decision_table(groups, "m", decisions, ["to"]).collect()}
    assert found == {"a": "all", "b": "one", "c": None}


def test_many_decisions_in_a_table(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows, first = [], {}
    for pos in range(10_000):
        method, chosen = f"m{pos % 4}", [rng.choice(words) for _ in range(rng.randrange(1, 4))]
        rows.append((pos, method, chosen, f"to{pos}"))
        first.setdefault((method, frozenset(chosen)), f"to{pos}")
    decisions = spark.createDataFrame(rows, "pos int, method string, features array<string>, to string")
    members = [(k, rng.choice([*words[:12], "foreign" if k % 9 == 0 else "w1"])) for k in range(300) for _ in range(3)]
    members += [(1000, None), (1000, "w1")]
    df = spark.createDataFrame(members, "k long, f string")
    method = F.concat(F.lit("m"), (F.col("k") % 5).cast("string"))
    groups = R.feature_sets(df, ["k"], "f", decisions).withColumn("m", method)
    found = {r.k: r.to for r in R.match_decision_table(groups, "m", decisions, ["to"]).collect()}
    sets = {}
    for k, word in members:
        sets.setdefault(k, set()).add(word)
    assert found == {k: first.get((f"m{k % 5}", frozenset(v))) for k, v in sets.items()}
    assert sum(to is not None for to in found.values()) > 20
    few = rows[:60]
    listed = [R.Decision(m, tuple(f), {"to": to}) for _, m, f, to in few]
    for form in (listed, spark.createDataFrame(few, decisions.schema)):
        groups = R.feature_sets(df, ["k"], "f", form).withColumn("m", method)
        out = {(r.k, r.features, r.to) for r in R.match_decision_table(groups, "m", form, ["to"]).collect()}
        known = {w for _, _, f, _ in few for w in f}
        assert {k for k, *_ in out} == set(sets)
        assert all(set(words_.split(",")) - {""} == sets[k] & known for k, words_, _ in out)
        results = {k: to for k, _, to in out}
        assert results == (results if form is listed else previous)
        previous = results


def test_decision_table_compares_sets(spark):
    decisions = [
        R.Decision("m", ("gex", "vdj"), {"pipe": "multi"}),
        R.Decision("m", ("vdj", "gex", "gex"), {"pipe": "never"}),
        R.Decision("m", ("gex",), {"pipe": "count"}),
    ]
    members = {
        "a": ["gex", "vdj", "gex"],
        "b": ["gex", "gex"],
        "c": ["gex", "atac"],
        "d": ["vdj"],
        "e": ["gex", None],
    }
    df = spark.createDataFrame([(k, f) for k, fs in members.items() for f in fs], "k string, f string")
    groups = R.feature_sets(df, ["k"], "f", decisions).withColumn("m", F.lit("m"))
    found = {r.k: r.pipe for r in R.match_decision_table(groups, "m", decisions, ["pipe"]).collect()}
    assert found == {"a": "multi", "b": "count", "c": None, "d": None, "e": None}


def test_reference_misses_at_any_hop(spark):
    keys = dimension(spark, "feature string, ref_key string", [("gex", "gex"), ("cite", "gex"), ("vdj", "vdj")])
    refs = dimension(spark, "ref_key string, organism string, path string", [("gex", "human", "/h")])
    df = spark.createDataFrame(
        [("gex", "human"), ("cite", "human"), ("gex", "mouse"), ("vdj", "human"), ("none", "human")],
        "f string, o string",
    )
    found = {(r.f, r.o): (r.ref_key, r.ref_path) for r in R.reference_for(df, "f", "o", keys, refs).collect()}
    assert found == {
        ("gex", "human"): ("gex", "/h"),
        ("cite", "human"): ("gex", "/h"),
        ("gex", "mouse"): ("gex", None),
        ("vdj", "human"): ("vdj", None),
        ("none", "human"): (None, None),
    }


def test_realms_need_registration(spark):
    with pytest.raises(ValueError):
        Realms().apply(methods(spark), "method", RULES)


def test_realms_read_the_documents_once(spark):
    """Each realm reads its own slice of what was routed, whatever its name looks like."""
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None), (5, "z")], "id long, method string")
    rules = [R.Rule("x", "007"), R.Rule("y", "yes"), R.Rule("z", "lost")]
    realms = Realms()
    realms.register_realm("007", lambda df: df.selectExpr("id", "realm", "'seven' AS by"))
    realms.register_realm("yes", lambda df: df.selectExpr("id", "realm", "'yes' AS by"))
    out = realms.apply(docs, "method", rules)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "007", "seven"), (2, "yes", "yes"), (3, "007", "seven")]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and text.count("PartitionFilters: [isnotnull(realm") == 2
    assert realms.apply(docs.limit(0), "method", rules).collect() == []
