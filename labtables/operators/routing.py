"""Which realm, workflow, reference or handler a row goes to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.functions._cols import (
    ColumnOrName,
    as_col,
    case_lookup,
    seen_words,
)

@dataclass(frozen=True)
class Rule:
    """One registry entry; only entries marked ``prefix`` match by prefix."""

    key: str
    target: str
    prefix: bool = False


#: Rules as a list become one CASE expression: no join, for short registries.  A table
#: (``pos, key, target, is_prefix``) of any length is joined.  Both give the same.
Rules = list[Rule] | DataFrame


def route_target(method: ColumnOrName, rules: list[Rule]) -> Column:
    """Target of a method: its exact entry, else the first prefix entry.

    Case and spaces count.  The rules become one CASE expression, so routing
    needs neither a join nor a shuffle.
    """
    method = as_col(method)
    chain = None
    exact = [(method == F.lit(r.key), r.target) for r in rules]
    prefix = [(F.startswith(method, F.lit(r.key)), r.target) for r in rules if r.prefix]
    for condition, target in exact + prefix:
        target = F.lit(target)
        chain = F.when(condition, target) if chain is None else chain.when(condition, target)
    return chain if chain is not None else F.lit(None).cast("string")


def with_target(df: DataFrame, method: str, rules: Rules, out: str = "target") -> DataFrame:
    """All rows with their target; null for unknown methods.

    For a table of rules each distinct method is expanded to its own prefixes, which
    turns the prefix test into an equi-join.
    """
    if not isinstance(rules, DataFrame):
        return df.withColumn(out, route_target(method, rules))
    methods = df.select(F.col(method).alias("_method")).where("_method IS NOT NULL").distinct()
    prefixes = methods.select(
        "_method",
        F.explode(F.sequence(F.lit(0), F.length("_method"))).alias("_length"),
    ).withColumn("_key", F.left("_method", F.col("_length")))
    exact = F.col("_rule.key") == F.col("_method")
    best = (
        prefixes.join(rules.select(F.struct("*").alias("_rule")), F.col("_key") == F.col("_rule.key"))
        .where(exact | F.col("_rule.is_prefix"))
        .groupBy("_method")
        .agg(F.min_by("_rule.target", F.struct(~exact, F.col("_rule.pos"))).alias("_target"))
    )
    return (
        df.join(best, F.col(method) == F.col("_method"), "left")
        .withColumn(out, F.col("_target"))
        .drop("_method", "_target")
    )


def route(df: DataFrame, method: str, rules: Rules, out: str = "target") -> DataFrame:
    """Rows with a target; rows of unknown methods are dropped (see :func:`unrouted`)."""
    return with_target(df, method, rules, out).where(F.col(out).isNotNull())


def unrouted(df: DataFrame, method: str, rules: Rules) -> DataFrame:
    """Side output of :func:`route`: how many rows each unknown method has."""
    return (
        with_target(df.select(method), method, rules, "_out")
        .where("_out IS NULL")
        .groupBy(method)
        .agg(F.count("*").alias("n_rows"))
    )


def route_by_table(
    df: DataFrame, method: str, registry: DataFrame, out: str = "target"
) -> DataFrame:
    """:func:`route` by a table of rules."""
    return route(df, method, registry, out)


@dataclass(frozen=True)
class Decision:
    """One decision-table entry: a method and a *set* of features."""

    method: str
    features: tuple[str, ...]
    outputs: dict[str, str | bool] = field(default_factory=dict)


#: Decisions as a list become one CASE expression.  A table (``pos, method, features`` and the
#: outputs) of any length is joined.  Both give the same.
Decisions = list[Decision] | DataFrame


def feature_sets(
    members: DataFrame, keys: list[str], feature: str, decisions: Decisions, *also: Column
) -> DataFrame:
    """The feature set of each group, in the order of the decision table's vocabulary.

    ``also``: further aggregates of the members, worked out in the same pass.

    ``members`` has one row per member of a group.  A feature outside the
    vocabulary is only noted, since such a group cannot match.  A set is no longer
    than the vocabulary, so a group may be of any size.
    """
    if isinstance(decisions, DataFrame):
        words = decisions.select(F.explode("features").alias("_word")).distinct()
        return (
            members.join(words, F.col(feature) == F.col("_word"), "left")
            .groupBy(*keys)
            .agg(
                F.array_sort(F.collect_set("_word")).alias("features"),
                F.bool_or(F.col("_word").isNull()).alias("has_foreign_feature"),
                *also,
            )
        )
    vocabulary = _vocabulary(decisions)
    known = F.coalesce(F.col(feature).isin(*vocabulary), F.lit(False))
    return members.groupBy(*keys).agg(
        seen_words(feature, vocabulary).alias("features"),
        F.bool_or(~known).alias("has_foreign_feature"),
        *also,
    )


def match_decision_table(
    groups: DataFrame, method: str, decisions: Decisions, outputs: list[str]
) -> DataFrame:
    """Outputs of the first decision with a group's method and feature set.

    ``groups`` comes from :func:`feature_sets`, with the method added.  Nulls
    where nothing matches.
    """
    if isinstance(decisions, DataFrame):
        return _match_rows(groups, method, decisions, outputs)
    first: dict[tuple[str, tuple[str, ...]], Decision] = {}
    for d in decisions:
        first.setdefault((d.method, tuple(sorted(set(d.features)))), d)
    chosen = {name: F.lit(None) for name in outputs}
    for (key, words), d in first.items():
        wanted = F.array(*[F.lit(word) for word in words]).cast("array<string>")
        test = (
            (F.col(method) == F.lit(key))
            & (F.col("features") == wanted)
            & ~F.col("has_foreign_feature")
        )
        for name in outputs:
            chosen[name] = F.when(test, F.lit(d.outputs.get(name))).otherwise(chosen[name])
    return groups.select(
        *[c for c in groups.columns if c not in ("features", "has_foreign_feature")],
        F.array_join("features", ",").alias("features"),
        *[column.alias(name) for name, column in chosen.items()],
    )


def _match_rows(
    groups: DataFrame, method: str, decisions: DataFrame, outputs: list[str]
) -> DataFrame:
    """By an equi-join on method and sorted features; of equal decisions the first one stays."""
    chosen = decisions.select(
        F.col("method").alias("_method"),
        F.array_sort(F.array_distinct("features")).alias("_features"),
        "pos",
        F.struct(*outputs).alias("_outputs"),
    )
    chosen = chosen.groupBy("_method", "_features").agg(F.min_by("_outputs", "pos").alias("_outputs"))
    wanted = F.when(~F.col("has_foreign_feature"), F.col("features"))
    return groups.join(
        chosen, (F.col(method) == F.col("_method")) & (wanted == F.col("_features")), "left"
    ).select(
        *[c for c in groups.columns if c not in ("features", "has_foreign_feature")],
        F.array_join("features", ",").alias("features"),
        *[F.col(f"_outputs.{name}").alias(name) for name in outputs],
    )


def _vocabulary(decisions: list[Decision]) -> list[str]:
    return sorted({f for d in decisions for f in d.features})


def reference_for(
    samples: DataFrame,
    feature: str,
    organism: str,
    feature_keys: DataFrame,
    references: DataFrame,
) -> DataFrame:
    """Adds ``ref_key`` and ``ref_path``; null from the first hop that misses.

    ``feature_keys`` is (feature, ref_key), ``references`` is
    (ref_key, organism, path).
    """
    keys = feature_keys.select(
        F.col("feature").alias("_feature"), F.col("ref_key").alias("ref_key")
    )
    paths = references.select(
        F.col("ref_key").alias("_ref_key"),
        F.col("organism").alias("_organism"),
        F.col("path").alias("ref_path"),
    )
    return (
        samples.join(keys, F.col(feature) == F.col("_feature"), "left")
        .join(
            paths,
            (F.col("ref_key") == F.col("_ref_key")) & (F.col(organism) == F.col("_organism")),
            "left",
        )
        .drop("_feature", "_ref_key", "_organism")
    )


def event_target(event_type: ColumnOrName, handlers: dict[str, str]) -> Column:
    """Handler name of an event type; null when none is registered."""
    return case_lookup(event_type, handlers, F.lit(None).cast("string"))
