"""Personal data by weak supervision, in DataFrame functions.

Spans of four kinds (email, ip, card, phone) are found in whole texts.  A base span is a match of
its kind's pattern that passes its kind's check; base spans always stay.  Candidates are all
matches of the base patterns, checked or not, and of a wider pattern per kind.  Labelers vote on
each candidate: its pattern and check, a gazetteer of known beginnings and endings, cue words in
the context, and what stands next to it.  Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is for each kind (they have no truth to compare
with); the probabilities it gives the candidates train the final classifier, a naive Bayes model
over features of the span that the labelers don't see alone.  Candidates that it gives at least
ACCEPT, and that overlap no base span, are added; a base match that fails its check is a
counterexample to learn from and never added.

Extraction is row by row, with one array of candidates per document and no shuffle; that table is
written to the shared scratch folder.  Only counts of vote patterns (3^labelers per kind at most)
and of feature values are gathered.  Patterns cannot backtrack, so work is linear in the text.

Defined cases: a null text is the empty text; a text without candidates has zero counts, empty
spans and the hash of the empty string; repeated rows are judged each; without any candidate the
models are empty and nothing is added; of two added spans that overlap, the one of the kind listed
first stays, then the one that starts first; a very long text is one row, and work on its spans
grows little faster than their number; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.llm._common import texts
from labtables.session import scratch_dir

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
EM_ROUNDS = 25
CONTEXT = 32
SHAPES = 64
# Positions are summed in chunks, so that many matches in one text stay cheap.
CHUNK = 64
# Spans of one text that are gone through between two copies of what was put out.
SCAN_CHUNK = 256

# A match may begin where a run of its characters begins, or right after the match before.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9.])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
# Without this in the text there is no match: a cheap test before the patterns.
_SIGN = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
}
_WIDE_SIGN = {
    "email": r"[\[(]at[\])]",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]",
    "card": r"[0-9]{4}[./][0-9]{4}",
    "phone": r"[0-9]{3}[\x20.-][0-9]{4}",
}

# Gazetteers: what spans of a kind (first entry) or of none (second) look like.
GAZETTEER = {
    "email": (r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", r"(?i)\.(?:png|jpg|gif|html?|js)$"),
    "ip": (r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0|127|255)\."),
    "card": (r"^(?:4|5[1-5]|3[47]|6011|65)", r"^(?:0|9)"),
    "phone": (r"^\+?(?:1\x20)?\(?[2-9]", r"^\+?0{2}"),
}
# Cue words before spans of a kind, and before numbers of other kinds.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|master ?card|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|cell|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
}
OTHER_CUES = r"(?i)\b(?:version|isbn|issn|order|invoice|serial|section|figure|id|hash|token|key)\b"
LABELERS = ("pattern", "gazetteer", "context", "neighbours")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, sign: str) -> Column:
    """array<struct<gap, hit, after>>, empty where the sign is missing."""
    test = F.contains(text, F.lit(sign)) if len(sign) == 1 else text.rlike(sign)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _let(
        F.split(text, pattern, -1),
        lambda gaps: F.transform(
            hits,
            lambda hit, i: F.struct(
                F.get(gaps, i).alias("gap"), hit.alias("hit"), F.get(gaps, i + 1).alias("after")
            ),
        ),
    )
    return F.when(test, found).otherwise(F.array().cast("array<struct<gap:string,hit:string,after:string>>"))


def _placed(matches: Column) -> Column:
    """Adds where each match starts and stops, in code points."""
    return _let(matches, _placed_once)


def _placed_once(found: Column) -> Column:
    item = "struct<start:long,stop:long,hit:string,before:string,after:string>"

    def long(x: Column) -> Column:
        return F.length(x).cast("long")

    def step(state: Column, one: Column) -> Column:
        start = state["at"] + long(one["gap"])
        stop = start + long(one["hit"])
        new = F.struct(
            start.alias("start"),
            stop.alias("stop"),
            one["hit"].alias("hit"),
            F.right(one["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(one["after"], F.lit(1)).alias("after"),
        )
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(new)).alias("out"))

    def chunk(state: Column, number: Column) -> Column:
        part = F.slice(found, number * CHUNK + 1, F.lit(CHUNK))
        empty = F.struct(state["at"].alias("at"), F.array().cast(f"array<{item}>").alias("out"))
        done = F.aggregate(part, empty, step)
        return F.struct(
            done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")
        )

    numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{item}>>").alias("out")
    )
    whole = F.flatten(F.aggregate(numbers, start, chunk, lambda state: state["out"]))
    return F.when(F.size(found) > 0, whole).otherwise(F.array().cast(f"array<{item}>"))


def _passes(kind: str, hit: Column) -> Column:
    """The check of a base span."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(
            F.split(hit, r"\."),
            lambda part: F.coalesce(part.try_cast("bigint"), F.lit(256).cast("bigint")) <= 255,
        )
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _judged(kind: str, placed: Column, wide: bool) -> Column:
    """Candidates of a kind with the labelers' votes and the classifier's features."""
    number = KINDS.index(kind)

    def one(c: Column) -> Column:
        base = F.lit(False) if wide else _passes(kind, c["hit"])
        before, after = F.right(c["before"], F.lit(1)), c["after"]
        alone = r"^[\s,;:()\[\]\"'.!?]?$"
        votes = F.array(
            F.lit(0) if wide else F.when(base, 1).otherwise(-1),
            _vote(c["hit"].rlike(GAZETTEER[kind][0]), c["hit"].rlike(GAZETTEER[kind][1])),
            _vote(c["before"].rlike(CUES[kind]), c["before"].rlike(OTHER_CUES)),
            _vote(
                before.rlike(alone) & after.rlike(alone),
                before.rlike(r"^[\p{L}\p{N}_=/\\]$") | after.rlike(r"^[\p{L}\p{N}_=/\\]$"),
            ),
        )
        shape = F.regexp_replace(F.regexp_replace(c["hit"], r"[A-Za-z]+", "a"), r"[0-9]", "9")
        features = F.array(
            F.least(F.length(c["hit"]), F.lit(40)),
            F.pmod(F.xxhash64(shape), F.lit(SHAPES)).cast("int"),
            F.least(F.length(F.regexp_replace(c["hit"], "[^0-9]", "")), F.lit(20)),
            F.size(F.array_distinct(F.split(F.regexp_replace(c["hit"], "[^0-9]", ""), ""))),
        )
        return F.struct(
            F.lit(number).alias("kind"),
            c["start"].alias("start"),
            c["stop"].alias("stop"),
            base.alias("base"),
            votes.alias("votes"),
            features.alias("features"),
        )

    # Digit runs too short for their kind are no candidates.
    least = {"card": 12, "phone": 7}.get(kind, 0)
    long = F.filter(placed, lambda c: F.length(F.regexp_replace(c["hit"], "[^0-9]", "")) >= least)
    return F.transform(long if least else placed, one)


def candidates(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and its candidates, one row per document; ``carry`` adds the row itself."""
    more = [F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")] if carry else []
    read = texts(docs, *more)
    text = F.col("text")
    arrays = []
    for kind in KINDS:
        for wide, pattern, sign in ((False, BASE[kind], _SIGN[kind]), (True, WIDE[kind], _WIDE_SIGN[kind])):
            arrays.append(_judged(kind, _placed(_matches(text, pattern, sign)), wide))
    return read.select("doc_id", F.concat(*arrays).alias("found"), *(["row"] if carry else []))


# --------------------------------------------------------------------------
# Models, from counts
# --------------------------------------------------------------------------


def reliabilities(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Probability of personal data for each vote pattern of one kind, by EM.

    Each labeler has a probability for each vote (no, none, yes) given the truth; they start
    from the belief that votes are right more often than wrong.
    """
    if not counts:
        return {}
    n = len(next(iter(counts)))
    total = sum(counts.values())
    votes = (-1, 0, 1)
    given = [
        {True: {-1: 0.1, 0: 0.3, 1: 0.6}, False: {-1: 0.6, 0: 0.3, 1: 0.1}} for _ in range(n)
    ]
    prior = 0.5
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(EM_ROUNDS):
        for pattern in counts:
            log = math.log(prior / (1 - prior))
            for k, vote in enumerate(pattern):
                log += math.log(given[k][True][vote] / given[k][False][vote])
            posterior[pattern] = 1 / (1 + math.exp(-max(-50.0, min(50.0, log))))
        yes = sum(counts[p] * posterior[p] for p in counts)
        prior = min(max(yes / total, 0.01), 0.99)
        for k in range(n):
            for truth, weight in ((True, yes), (False, total - yes)):
                for vote in votes:
                    mass = sum(
                        counts[p] * (posterior[p] if truth else 1 - posterior[p])
                        for p in counts
                        if p[k] == vote
                    )
                    # A few counts of the first belief keep the truth from changing sides.
                    first = {(True, 1): 6, (True, -1): 1, (False, -1): 6, (False, 1): 1}
                    given[k][truth][vote] = (mass + first.get((truth, vote), 3)) / (weight + 10)
    return posterior


def _table(values: dict, key: Column, default: float) -> Column:
    """A lookup of a bounded table."""
    if not values:
        return F.lit(default)
    entries = [F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))]
    return F.coalesce(F.create_map(*entries)[key], F.lit(default))


def _code(kind: Column, values: Column) -> Column:
    return F.concat_ws(":", kind.cast("string"), F.array_join(values.cast("array<string>"), ","))


def train(found: DataFrame) -> Callable[[Column], Column]:
    """The final classifier: candidate struct -> probability."""
    each = found.select(F.explode("found").alias("c"))
    counts: dict[int, dict[tuple[int, ...], int]] = {}
    for row in each.groupBy("c.kind", "c.votes").count().collect():
        counts.setdefault(row["kind"], {})[tuple(row["votes"])] = row["count"]
    soft = {
        f"{kind}:{','.join(map(str, pattern))}": probability
        for kind, of_kind in counts.items()
        for pattern, probability in reliabilities(of_kind).items()
    }
    learned = (
        each.withColumn("p", _table(soft, _code(F.col("c.kind"), F.col("c.votes")), 0.5))
        .select("c.kind", "p", F.posexplode("c.features").alias("feature", "value"))
        .groupBy("kind", "feature", "value")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    totals: dict[int, list[float]] = {}
    for row in learned:
        if row["feature"] == 0:
            total = totals.setdefault(row["kind"], [0.0, 0.0])
            total[0] += row["yes"]
            total[1] += row["no"]
    weights = {}
    for row in learned:
        yes, no = totals[row["kind"]]
        share = ((row["yes"] + 1) / (yes + 2 * SHAPES)) / ((row["no"] + 1) / (no + 2 * SHAPES))
        weights[f"{row['kind']}:{row['feature']}:{row['value']}"] = math.log(share)
    prior = {str(k): math.log((yes + 1) / (no + 1)) for k, (yes, no) in totals.items()}
    believed = {k: math.log(max(p, 1e-6) / max(1 - p, 1e-6)) for k, p in soft.items()}

    def probability(c: Column) -> Column:
        log = _table(prior, c["kind"].cast("string"), 0.0)
        for k in range(4):
            key = F.concat_ws(":", c["kind"].cast("string"), F.lit(str(k)), c["features"][k].cast("string"))
            log = log + _table(weights, key, 0.0)
        # The votes count as one more feature, with the log odds that EM gave them.
        log = (log + _table(believed, _code(c["kind"], c["votes"]), 0.0)) / 2
        return 1 / (1 + F.exp(-log))

    return probability


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def find(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, base (array of spans), added (array of spans) of every document.

    ``carry`` keeps the whole row, as ``row``.

    A span is struct<kind int (place in KINDS), start long, stop long>, in code points.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "private-data")
    candidates(docs, carry).write.parquet(folder)
    found = spark.read.parquet(folder)
    probability = train(found)

    def span(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))

    accepted = F.filter("found", lambda c: (c["votes"][0] == 0) & (probability(c) >= ACCEPT))
    return (
        found.withColumn("base", F.transform(F.filter("found", lambda c: c["base"]), span))
        .withColumn("likely", F.transform(accepted, span))
        .withColumn("added", _added(F.col("base"), F.col("likely")))
        .select("doc_id", "base", "added", *(["row"] if carry else []))
    )


_MARKED = "struct<start:long,rank:int,kind:int,stop:long,lost:boolean>"
_SPANS = "array<struct<kind:int,start:long,stop:long>>"
_NOWHERE = 1 << 62


def _scan(
    items: Column,
    item_type: str,
    start: Column,
    step: Callable[[Column, Column], tuple[Column, Column]],
) -> Column:
    """Goes through the items once.  ``step`` of what is carried and an item says what is carried
    on and, as an array, what is put out.  In chunks, so that the output is copied little."""

    def each(state: Column, one: Column) -> Column:
        carried, out = step(state["carried"], one)
        return F.struct(carried.alias("carried"), F.concat(state["out"], out).alias("out"))

    def chunk(state: Column, number: Column) -> Column:
        part = F.slice(items, number * SCAN_CHUNK + 1, F.lit(SCAN_CHUNK))
        empty = F.struct(state["carried"].alias("carried"), F.array().cast(f"array<{item_type}>").alias("out"))
        return _let(
            F.aggregate(part, empty, each),
            lambda done: F.struct(
                done["carried"].alias("carried"), F.concat(state["out"], F.array(done["out"])).alias("out")
            ),
        )

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SCAN_CHUNK).cast("int"))
    begin = F.struct(start.alias("carried"), F.array().cast(f"array<array<{item_type}>>").alias("out"))
    whole = F.flatten(F.aggregate(numbers, begin, chunk, lambda state: state["out"]))
    return F.when(F.size(items) > 0, whole).otherwise(F.array().cast(f"array<{item_type}>"))


def _marked(one: Column, lost: Column) -> Column:
    kept = [one[name].alias(name) for name in ("start", "rank", "kind", "stop")]
    return F.struct(*kept, lost.alias("lost"))


def _added(base: Column, likely: Column) -> Column:
    """Likely spans that overlap no base span, and none of these that comes first by kind and start.

    Sorted by start, a span overlaps an earlier one if the furthest stop so far is beyond its
    start, and a later one if the nearest start behind it is before its stop: each question is one
    pass forward and one backward.
    """

    def ranked(spans: Column, rank: int) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(rank).alias("rank"),
                s["kind"].alias("kind"),
                s["stop"].alias("stop"),
                F.lit(False).alias("lost"),
            ),
        )

    none = F.array().cast(f"array<{_MARKED}>")
    far = F.lit(_NOWHERE).cast("long")
    zero = F.lit(0).cast("long")

    def base_before(furthest: Column, one: Column) -> tuple[Column, Column]:
        is_base = one["rank"] == 0
        out = _marked(one, ~is_base & (furthest > one["start"]))
        return F.when(is_base, F.greatest(furthest, one["stop"])).otherwise(furthest), F.array(out)

    def base_behind(nearest: Column, one: Column) -> tuple[Column, Column]:
        is_base = one["rank"] == 0
        out = F.when(is_base | one["lost"] | (nearest < one["stop"]), none).otherwise(F.array(one))
        return F.when(is_base, one["start"]).otherwise(nearest), out

    def kinds_before(furthest: Column, one: Column) -> tuple[Column, Column]:
        lost = F.lit(False)
        for k in range(len(KINDS)):
            lost = lost | ((one["kind"] >= k) & (furthest[f"k{k}"] > one["start"]))
        carried = [
            F.when(one["kind"] == k, F.greatest(furthest[f"k{k}"], one["stop"])).otherwise(furthest[f"k{k}"]).alias(f"k{k}")
            for k in range(len(KINDS))
        ]
        return F.struct(*carried), F.array(_marked(one, lost))

    def kinds_behind(nearest: Column, one: Column) -> tuple[Column, Column]:
        lost = one["lost"]
        for k in range(len(KINDS)):
            lost = lost | ((one["kind"] > k) & (nearest[f"k{k}"] < one["stop"]))
        carried = [
            F.when(one["kind"] == k, one["start"]).otherwise(nearest[f"k{k}"]).alias(f"k{k}") for k in range(len(KINDS))
        ]
        return F.struct(*carried), F.when(lost, none).otherwise(F.array(one))

    def of_kinds(value: Column) -> Column:
        return F.struct(*[value.alias(f"k{k}") for k in range(len(KINDS))])

    def passes(items: Column) -> Column:
        return _let(
            _scan(items, _MARKED, zero, base_before),
            lambda seen: _let(
                F.reverse(seen),
                lambda back: _let(
                    F.reverse(_scan(back, _MARKED, far, base_behind)),
                    lambda free: _let(
                        F.reverse(_scan(free, _MARKED, of_kinds(zero), kinds_before)),
                        lambda judged: _scan(judged, _MARKED, of_kinds(far), kinds_behind),
                    ),
                ),
            ),
        )

    everything = F.array_sort(F.concat(ranked(base, 0), ranked(likely, 1)))
    left = F.transform(
        _let(everything, passes),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")),
    )
    return F.when(F.size(likely) > 0, F.array_sort(left)).otherwise(F.array().cast(_SPANS))


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, spans in the text replaced by [EMAIL], [IP] and so on, and n_chars,
    if there is one, by the new length.  Overlapping spans are one, named by the first."""
    found = find(docs, carry=True)
    spans = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")),
        )
    )
    text = F.col("row.text")
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])

    strings = F.array().cast("array<string>")

    def chunk(spans: Column, state: Column, number: Column) -> Column:
        """Some spans and the stretch of text that they lie in, which is cut out once."""
        part = F.slice(spans, number * SCAN_CHUNK + 1, F.lit(SCAN_CHUNK))
        first = state["at"]
        last = F.greatest(first, F.array_max(F.transform(part, lambda s: s["stop"])))
        stretch = F.substring(text, first.cast("int") + 1, (last - first).cast("int"))

        def step(stretch: Column) -> Callable[[Column, Column], Column]:
            def one(state: Column, s: Column) -> Column:
                gap = F.substring(
                    stretch, (state["at"] - first).cast("int") + 1, (s["start"] - state["at"]).cast("int")
                )
                grown = F.concat(state["out"], F.array(gap, F.get(names, s["kind"])))
                free = s["start"] >= state["at"]
                return F.struct(
                    F.greatest(state["at"], s["stop"]).alias("at"),
                    F.when(free, grown).otherwise(state["out"]).alias("out"),
                )

            return one

        done = _let(
            stretch,
            lambda stretch: F.aggregate(
                part, F.struct(first.alias("at"), strings.alias("out")), step(stretch)
            ),
        )
        return _let(
            done,
            lambda done: F.struct(
                done["at"].alias("at"),
                F.concat(state["out"], F.array(F.array_join(done["out"], ""))).alias("out"),
            ),
        )

    def replaced(spans: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / SCAN_CHUNK).cast("int"))
        return F.aggregate(
            numbers,
            F.struct(F.lit(0).cast("long").alias("at"), strings.alias("out")),
            lambda state, number: chunk(spans, state, number),
            lambda state: F.concat(
                F.array_join(state["out"], ""),
                F.substring(text, state["at"].cast("int") + 1, F.length(text)),
            ),
        )

    new = _let(spans, replaced)
    changed = found.withColumn("new", F.when(F.size(spans) > 0, new).otherwise(text))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("new").alias("text"))
        elif name == "n_chars":
            length = F.length("new").cast(docs.schema[name].dataType)
            kept = F.when(F.size(spans) > 0, length).otherwise(F.col("row")[name])
            columns.append(kept.alias(name))
        else:
            columns.append(F.col("row")[name].alias(name))
    return changed.select(*columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind and the spans as text."""
    everything = F.array_sort(F.concat("base", "added"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.array_sort("base")), 256).alias("base_sha256"),
        _written(everything).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
