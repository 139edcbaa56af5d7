"""Delivery: reports, decisions, and what was handed over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.functions._cols import ColumnOrName, as_col, blank_to_null
from labtables.functions.status import delivery_action, passed_qc, to_deliver
from labtables.operators.lifecycle import summarise_samples


def latest_report(reports: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The last report entry of every project that has one."""
    last = F.max_by(F.struct(*columns), seq).alias("_last")
    return reports.groupBy(key).agg(last).select(key, *[F.col(f"_last.{c}") for c in columns])


def delivery_decisions(
    projects: DataFrame,
    samples: DataFrame,
    reports: DataFrame,
    key: str,
    qc: str = "qc",
    seq: str = "seq",
    partial: str = "partial_delivery_allowed",
    labels: dict[str, str] | None = None,
    out: str = "action",
) -> DataFrame:
    """The next delivery step of every project.

    Samples and reports are each reduced to one row per project first; both
    reductions and both joins use the same key, hence the same partitioning.
    """
    flags = summarise_samples(samples, key, qc=qc)
    last = latest_report(reports, key, seq, ["signee", "rejected"]).withColumn(
        "has_report", F.lit(True)
    )
    action = delivery_action(
        "any_pending",
        "any_passed",
        "all_passed_or_aborted",
        "all_aborted",
        "has_report",
        "signee",
        "rejected",
        partial,
        labels,
    )
    return (
        projects.join(flags, key, "left")
        .join(last, key, "left")
        .select(*projects.columns, action.alias(out))
    )


def mark_delivered(
    samples: DataFrame, qc: str = "qc", delivered: str = "delivered"
) -> DataFrame:
    """Samples with their new delivered flag; a row-wise change, no join."""
    return samples.withColumn(
        delivered, F.coalesce(F.col(delivered), F.lit(False)) | to_deliver(qc, delivered)
    )


def delivered_now(samples: DataFrame, key: str, sample: str, qc: str, delivered: str) -> DataFrame:
    """The samples one delivery includes, one row each, keyed by project.

    This is the delivery entry's sample list kept as rows, since a project's
    list has no size limit.
    """
    return samples.where(to_deliver(qc, delivered)).select(key, sample)


def delivery_entries(
    projects: DataFrame,
    samples: DataFrame,
    key: str,
    qc: str = "qc",
    delivered: str = "delivered",
    default_id: str = "DDS123",
    dds_id: str = "dds_project_id",
    now: ColumnOrName | None = None,
) -> DataFrame:
    """One new delivery entry per project, also when no sample is left to send.

    With ``now`` it has the upload and release dates too; its samples are the rows of
    :func:`delivered_now`.
    """
    dates = [] if now is None else [as_col(now).alias("date_uploaded"), as_col(now).alias("date_released")]
    counts = samples.groupBy(key).agg(
        F.count_if(to_deliver(qc, delivered)).alias("n_included")
    )
    return projects.join(counts, key, "left").select(
        key,
        F.coalesce(F.col(dds_id), F.lit(default_id)).alias("dds_project_id"),
        F.coalesce("n_included", F.lit(0)).alias("n_included"),
        F.lit("unknown").alias("total_volume"),
        F.lit("delivered").alias("delivery_status"),
        *dates,
    )


def new_reports(
    projects: DataFrame,
    samples: DataFrame,
    key: str,
    sample: str,
    now: ColumnOrName,
    qc: str = "qc",
    name: str | None = None,
    suffix: str = S.REPORT_SUFFIX,
) -> tuple[DataFrame, DataFrame]:
    """Unsigned report entries of the given projects, and the samples in them as rows.

    A report includes all Passed samples, delivered or not; a project without any gets
    none.  Its file is named by the projects' column ``name``, or by the key where there is none.
    """
    included = samples.where(passed_qc(qc)).select(key, sample)
    included = included.join(projects.select(key), key, "left_semi")
    entries = included.groupBy(key).agg(F.count("*").alias("n_included"))
    own = F.col(key).cast("string")
    if name is not None:
        entries = entries.join(projects.select(key, F.col(name).alias("_name")), key)
        own = F.coalesce(blank_to_null("_name"), own)
    return (
        entries.select(
            key,
            "n_included",
            F.concat(own, F.lit(suffix)).alias("file_name"),
            as_col(now).alias("date_created"),
            F.lit("").alias("signee"),
            F.lit("").alias("date_signed"),
            F.lit(False).alias("rejected"),
        ),
        included,
    )


def project_flowcells(
    projects: DataFrame,
    samples: DataFrame,
    key: str,
    flowcells: str,
    wanted: str = "deliver_flowcell",
) -> DataFrame:
    """Distinct flowcells, as rows, of the projects that want them delivered.

    Reduced to distinct rows before the join with the projects.
    """
    rows = samples.select(key, F.explode(flowcells).alias("flowcell")).distinct()
    return rows.join(projects.where(F.col(wanted)).select(key), key, "left_semi")
