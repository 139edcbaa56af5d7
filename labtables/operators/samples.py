"""Samples of a project: exploding, grouping, checking their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.functions._cols import (
    ColumnOrName,
    as_col,
    blank_to_null,
    seen_words,
)
from labtables.functions.text import flowcell_ages, flowcell_date


def explode_samples(docs: DataFrame, samples: str, *keep: str) -> DataFrame:
    """One row per sample of a document's sample map."""
    return docs.select(*keep, F.explode(samples).alias("sample_id", "sample"))


def explode_flowcells(samples: DataFrame, library_prep: str, *keep: str) -> DataFrame:
    """One row per flowcell over all preps, ``ordinal`` giving document order."""
    preps = samples.select(
        *keep, F.posexplode(F.map_entries(library_prep)).alias("_prep_pos", "_prep")
    )
    return preps.select(
        *keep,
        F.col("_prep.key").alias("prep"),
        "_prep_pos",
        F.posexplode("_prep.value.sequenced_fc").alias("_fc_pos", "flowcell"),
    ).select(
        *keep,
        "prep",
        F.struct("_prep_pos", "_fc_pos").alias("ordinal"),
        "flowcell",
    )


def latest_flowcell(
    flowcells: DataFrame, keys: list[str], flowcell: str = "flowcell", ordinal: str = "ordinal"
) -> DataFrame:
    """Flowcell with the latest date per key; the first met wins a tie.

    Undated flowcells do not count; keys with none are absent.
    """
    # The smallest (negated day, ordinal) is the latest date, and its first row.
    # A null order is ignored, so the date is worked out once and not filtered on.
    age = -F.unix_date(flowcell_date(flowcell))
    aged = flowcells.withColumn("_age", age)
    order = F.when(F.col("_age").isNotNull(), F.struct("_age", ordinal))
    best = F.min_by(flowcell, order).alias("latest_flowcell")
    return aged.groupBy(*keys).agg(best).where("latest_flowcell IS NOT NULL")


def flowcells_of_map(library_prep: ColumnOrName) -> Column:
    """All flowcells of one document's prep map, in its order."""
    return F.flatten(
        F.transform(
            F.map_values(as_col(library_prep)),
            lambda prep: F.coalesce(prep["sequenced_fc"], F.array().cast("array<string>")),
        )
    )


def latest_flowcell_of_map(library_prep: ColumnOrName) -> Column:
    """:func:`latest_flowcell` inside one document's prep map: no shuffle."""
    flowcells = flowcells_of_map(library_prep)
    dated = F.transform(
        flowcell_ages(flowcells), lambda age, i: F.struct(age.alias("age"), i.alias("pos"))
    )
    best = F.array_min(F.filter(dated, lambda x: x["age"].isNotNull()))
    return F.get(flowcells, best["pos"])


def sequencing_status(latest: ColumnOrName) -> Column:
    """Status of a sample before any work on it."""
    return F.when(as_col(latest).isNotNull(), F.lit("initialized")).otherwise(
        F.lit("unsequenced")
    )


def libraries_rows(
    members: DataFrame, feature: str, fastq_dirs: str, library_types: DataFrame, *keep: str
) -> DataFrame:
    """One row per member and FASTQ folder with its library type.

    ``fastq_dirs`` maps a flowcell to its folders.  Members whose feature has
    no library type are left out.
    """
    types = library_types.select(
        F.col("feature").alias("_feature"), F.col("library_type").alias("library_type")
    )
    return (
        members.join(types, F.col(feature) == F.col("_feature"))
        .select(*keep, "library_type", F.explode(fastq_dirs).alias("flowcell", "_dirs"))
        .select(*keep, "flowcell", F.explode("_dirs").alias("fastqs"), "library_type")
    )


def group_by_origin(
    members: DataFrame, keys: list[str], feature: str, features: list[str], flowcell: str
) -> DataFrame:
    """Run samples: members, distinct features and flowcells per origin.

    ``members`` has one row per member and flowcell.  The features come from a
    fixed vocabulary of any length.  Members and flowcells have no
    bound per group, so they stay rows of ``members``; here they are counted.
    """
    return members.groupBy(*keys).agg(
        F.count("*").alias("n_members"),
        F.array_join(seen_words(feature, features), ",").alias("features"),
        F.count_distinct(flowcell).alias("n_flowcells"),
    )


def distinct_flowcells(members: DataFrame, keys: list[str], flowcell: str) -> DataFrame:
    """All flowcells of every run sample, as rows."""
    return members.select(*keys, flowcell).distinct()


def reference_conflicts(
    members: DataFrame, keys: list[str], ref_key: str, path: str
) -> DataFrame:
    """Run samples with their reference state.

    A run sample fails when any member has no reference, or when one reference
    key resolves to more than one path.  Members are first reduced to distinct
    (run sample, key, path) rows, few per sample, then to one row per key with its number
    of paths.
    """
    found = F.col(path).isNotNull()
    references = members.select(*keys, ref_key, path).distinct()
    each = references.groupBy(*keys, ref_key).agg(
        F.count_if(found).alias("_paths"), F.bool_or(~found).alias("_missing")
    )
    return (
        each.groupBy(*keys)
        .agg(
            F.coalesce(F.bool_or(F.col("_paths") > 1), F.lit(False)).alias("conflict"),
            F.bool_or("_missing").alias("missing_reference"),
        )
        .withColumn("failed", F.col("conflict") | F.col("missing_reference"))
    )


def merge_tracking(
    samples: DataFrame,
    tracking: DataFrame,
    keys: list[str],
    status: str = "status",
    job_id: str = "job_id",
) -> DataFrame:
    """Samples with the tracked status, where there is one, and job id.

    ``tracking`` has one row per key.
    """
    known = tracking.select(
        *keys,
        F.col(status).alias("_status"),
        F.col(job_id).alias("_job_id"),
        F.lit(True).alias("_tracked"),
    )
    return (
        samples.join(known, keys, "left")
        .withColumn(status, F.coalesce(blank_to_null("_status"), F.col(status)))
        .withColumn(job_id, F.when(F.col("_tracked"), F.col("_job_id")).otherwise(F.col(job_id)))
        .drop("_status", "_job_id", "_tracked")
    )


def missing_outputs(
    samples: DataFrame,
    existing: DataFrame,
    keys: list[str],
    file: str,
    expected: list[str],
) -> DataFrame:
    """Which expected files each sample lacks, and whether it has them all.

    The files found are reduced to one small set per sample before the join, and
    nothing is expanded to samples x files.
    """
    expected = list(dict.fromkeys(expected))
    found = existing.groupBy(*keys).agg(seen_words(file, expected).alias("_found"))
    every = F.array(*[F.lit(name) for name in expected]).cast("array<string>")
    lacking = F.array_except(every, F.coalesce("_found", F.array().cast("array<string>")))
    return (
        samples.join(found, keys, "left")
        .withColumn("missing", F.array_join(lacking, ","))
        .withColumn("valid", F.size(lacking) == 0)
        .drop("_found")
    )


def samples_without_fastq(samples: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Samples for which no folder was found; a sample may have several folders."""
    return samples.join(inventory.select(*keys), keys, "left_anti")
