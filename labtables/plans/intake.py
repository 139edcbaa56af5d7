"""From changed project documents to tracked projects and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables.functions._cols import ColumnOrName, as_col, let
from labtables.functions.documents import missing_fields, project_info
from labtables.functions.status import not_aborted
from labtables.operators.routing import Rules, route, with_target
from labtables.operators.samples import (
    explode_samples,
    flowcells_of_map,
    latest_flowcell_of_map,
    sequencing_status,
)
from labtables.operators.upsert import init_projects
from labtables.sources.readers import typed


def missing_paths(
    variant: ColumnOrName, required: list[str], sample_required: list[str] | None = None
) -> Column:
    """All required paths a document lacks: its own, then ``samples.<name>.<path>`` of each."""
    own = missing_fields(variant, required)
    if not sample_required:
        return own
    samples = F.try_variant_get(as_col(variant), "$.samples", "map<string, variant>")
    lacking = F.transform(
        F.map_entries(samples),
        lambda entry: F.transform(
            missing_fields(entry["value"], sample_required),
            lambda path: F.concat(F.lit("samples."), entry["key"], F.lit("."), path),
        ),
    )
    return F.concat(own, F.coalesce(F.flatten(lacking), F.array().cast("array<string>")))


def complete_documents(
    docs: DataFrame, required: list[str], sample_required: list[str] | None = None
) -> DataFrame:
    """Documents that have every required field, in themselves and each sample.

    One look at each document, no shuffle.
    """
    return docs.where(
        let("variant", lambda v: F.size(missing_paths(v, required, sample_required)) == 0)
    )


METHOD = "doc.details.library_construction_method"


def rejected_documents(
    docs: DataFrame,
    rules: Rules,
    required: list[str],
    sample_required: list[str] | None = None,
) -> DataFrame:
    """Documents that go no further, with the reason: (doc_id, seq, reason, detail).

    ``malformed`` text, ``incomplete`` with the missing paths, or ``unrouted`` with the
    method.  With the documents that are handed on they make up all documents.
    """
    lacking = let("variant", lambda v: missing_paths(v, required, sample_required))
    checked = docs.select(
        "doc_id",
        "seq",
        F.col(METHOD).alias("method"),
        F.col("variant").isNull().alias("_malformed"),
        F.array_join(lacking, ",").alias("_missing"),
    )
    reason = (
        F.when(F.col("_malformed"), F.lit("malformed"))
        .when(F.col("_missing") != "", F.lit("incomplete"))
        .when(F.col("_target").isNull(), F.lit("unrouted"))
    )
    detail = (
        F.when(F.col("reason") == "incomplete", F.col("_missing"))
        .when(F.col("reason") == "unrouted", F.col("method"))
    )
    return (
        with_target(checked, "method", rules, "_target")
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .select("doc_id", "seq", "reason", detail.alias("detail"))
    )


def intake_projects(
    docs: DataFrame,
    rules: Rules,
    required: list[str],
    tracking: DataFrame,
    sample_required: list[str] | None = None,
) -> DataFrame:
    """Routed, complete projects with the action to take on each.

    The others are in :func:`rejected_documents`.
    """
    docs = complete_documents(docs, required, sample_required)
    info = project_info(typed(docs))
    return init_projects(route(info, "library_prep_method", rules), tracking, "project_id")


def intake_samples(docs: DataFrame, all_flowcells: bool = False) -> DataFrame:
    """Samples of documents that are not aborted, with latest flowcell and status.

    ``all_flowcells`` adds the list of all of them, without duplicates.
    """
    samples = explode_samples(typed(docs), "samples", "project_id")
    manual = F.try_element_at(F.col("sample.details"), F.lit("status_(manual)"))
    latest = latest_flowcell_of_map("sample.library_prep")
    every = F.coalesce(
        F.array_compact(F.array_distinct(flowcells_of_map("sample.library_prep"))),
        F.array().cast("array<string>"),
    )
    more = [every.alias("flowcells")] if all_flowcells else []
    return (
        samples.where(not_aborted(manual))
        .select("project_id", "sample_id", latest.alias("flowcell"), *more)
        .withColumn("status", sequencing_status("flowcell"))
    )
