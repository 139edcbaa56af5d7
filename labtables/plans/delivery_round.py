"""One delivery round over all projects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.functions._cols import ColumnOrName
from labtables.operators import delivery as D


@dataclass(frozen=True)
class Round:
    """What a delivery round does.

    ``entries`` and ``included`` (their samples, one row each) of the projects that go
    out now, ``samples`` as they all are after it, and ``reports`` and
    ``report_samples`` of the projects that need a new report to be signed.
    """

    entries: DataFrame
    included: DataFrame
    samples: DataFrame
    reports: DataFrame
    report_samples: DataFrame


def delivery_round(
    projects: DataFrame,
    samples: DataFrame,
    reports: DataFrame,
    key: str,
    sample: str,
    now: ColumnOrName,
    name: str | None = None,
) -> Round:
    """Every project's next step, taken.

    Only samples of projects whose decision is to proceed are marked.  New reports are named
    by the projects' column ``name`` where it is given.
    """
    decided = D.delivery_decisions(projects, samples, reports, key)
    going = decided.where(F.col("action") == "proceed_delivery")
    entries = D.delivery_entries(going, samples, key, now=now)
    included = D.delivered_now(samples, key, sample, "qc", "delivered").join(
        going.select(key), key, "left_semi"
    )
    flagged = samples.join(going.select(key, F.lit(True).alias("_going")), key, "left")
    before = F.coalesce(F.col("delivered"), F.lit(False))
    marked = (
        flagged.withColumn("_before", before)
        .transform(D.mark_delivered)
        .withColumn(
            "delivered", F.when(F.col("_going"), F.col("delivered")).otherwise(F.col("_before"))
        )
        .drop("_before", "_going")
    )
    due = decided.where(F.col("action") == "generate_report")
    new, in_them = D.new_reports(due, samples, key, sample, now, name=name)
    return Round(entries, included, marked, new, in_them)
