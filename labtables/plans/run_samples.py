"""Preparing run samples: from the lab samples of all projects to what each run needs.

Lab samples that belong to one origin make a run sample.  It gets its pipeline from the
decision table by the method and the set of its features, its references from those of its
members, and is ready (``pre_processed``) when nothing is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.functions.status import not_aborted
from labtables.operators.routing import (
    Decisions,
    feature_sets,
    match_decision_table,
    reference_for,
)
from labtables.operators.samples import reference_conflicts, samples_without_fastq
from labtables.sources.writers import multi_sheet_lines

KEYS = ["project_id", "run_sample"]
SAMPLE = ["project_id", "sample_id"]
OUTPUTS = ["pipeline", "submit", "files_to_generate"]


@dataclass(frozen=True)
class RunInputs:
    """Input tables.

    ``members`` (project_id, run_sample, sample_id, method, feature, organism, manual_status),
    one row per lab sample; ``inventory`` (project_id, sample_id, flowcell, folder) of its FASTQ
    folders; ``feature_keys`` (feature, ref_key), ``references`` (ref_key, organism, path) and
    ``library_types`` (feature, library_type); ``decisions`` with the outputs pipeline, submit
    and files_to_generate (words set apart by commas), as a list or a table.  ``tasks``: into how
    many tasks large tables are dealt; a number that grows with the members bounds the memory of
    each (adaptive execution joins small shuffle partitions up by their compressed size, and rows
    with long ids take many times that once read).
    """

    members: DataFrame
    inventory: DataFrame
    feature_keys: DataFrame
    references: DataFrame
    library_types: DataFrame
    decisions: Decisions
    tasks: int | None = None

    def dealt(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.repartition(self.tasks, *keys) if self.tasks else rows


def lab_samples(inputs: RunInputs) -> DataFrame:
    """Members that are not aborted, with ref_key and ref_path."""
    kept = inputs.members.where(not_aborted("manual_status"))
    return reference_for(kept, "feature", "organism", inputs.feature_keys, inputs.references)


def run_samples(inputs: RunInputs) -> DataFrame:
    """One row per run sample, with its status, and why it is not ready.

    ``failed``: a member has no reference, or two members disagree on one.
    ``pre_processing_failed``: a member has no FASTQ folder, or no decision matches.  The first
    reason that holds is given.  Every part is an aggregate over the same keys.
    """
    members = lab_samples(inputs)
    samples = inputs.dealt(members.select(*KEYS, "sample_id"), SAMPLE)
    folders = inputs.dealt(inputs.inventory.select(*SAMPLE), SAMPLE)
    members = inputs.dealt(members, KEYS)
    sizes = [F.max("method").alias("method"), F.count("*").alias("n_members")]
    sets = feature_sets(members, KEYS, "feature", inputs.decisions, *sizes)
    lacking = inputs.dealt(samples_without_fastq(samples, folders, SAMPLE), KEYS)
    lacking = lacking.groupBy(*KEYS).agg(F.count("*").alias("n_without_fastq"))
    groups = match_decision_table(sets, "method", inputs.decisions, OUTPUTS)
    whole = groups.join(reference_conflicts(members, KEYS, "ref_key", "ref_path"), KEYS).join(
        lacking, KEYS, "left"
    )
    without = F.coalesce("n_without_fastq", F.lit(0))
    reason = (
        F.when(F.col("missing_reference"), F.lit("missing reference"))
        .when(F.col("conflict"), F.lit("conflicting references"))
        .when(without > 0, F.lit("missing FASTQ files"))
        .when(F.col("pipeline").isNull(), F.lit("no pipeline"))
    )
    status = (
        F.when(F.col("failed"), F.lit("failed"))
        .when(reason.isNotNull(), F.lit("pre_processing_failed"))
        .otherwise(F.lit("pre_processed"))
    )
    return whole.select(
        *KEYS, "method", "n_members", "features", *OUTPUTS, status.alias("status"), reason.alias("reason")
    )


def _ready(runs: DataFrame, file: str) -> DataFrame:
    wanted = F.array_contains(F.split("files_to_generate", ","), file)
    return runs.where((F.col("status") == "pre_processed") & wanted).select(*KEYS)


def library_rows(inputs: RunInputs, runs: DataFrame, file: str = "libraries_csv") -> DataFrame:
    """Rows (keys, fastqs, sample, library_type) of the run samples that need ``file``.

    Members whose feature has no library type are left out.
    """
    types = inputs.library_types.select("feature", "library_type")
    members = inputs.dealt(lab_samples(inputs).select(*KEYS, "sample_id", "feature"), KEYS)
    typed = members.join(_ready(runs, file), KEYS, "left_semi").join(types, "feature")
    folders = inputs.inventory.select(*SAMPLE, F.col("folder").alias("fastqs"))
    return (
        inputs.dealt(typed, SAMPLE)
        .join(inputs.dealt(folders, SAMPLE), SAMPLE)
        .select(*KEYS, "fastqs", F.col("sample_id").alias("sample"), "library_type")
    )


def sheet_lines(
    inputs: RunInputs,
    runs: DataFrame,
    sections: list[tuple[str, str | None, list[str]]],
    file: str = "multi_csv",
) -> DataFrame:
    """Lines of the sectioned sheets of the run samples that need ``file``; ``run`` names the sheet."""
    run = F.concat_ws("_", *KEYS).alias("run")
    ready = _ready(runs, file)
    members = inputs.dealt(lab_samples(inputs), KEYS).join(ready, KEYS, "left_semi")
    paths = inputs.dealt(members.select(run, "ref_key", "ref_path"), ["run"]).distinct()
    libraries = library_rows(inputs, runs, file).select(run, "fastqs", "sample", "library_type")
    return multi_sheet_lines(ready.select(run), libraries, paths, "run", sections)
