"""After a run: from its log and its outputs to the sample's last status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.functions.status import post_process_bucket
from labtables.functions.text import report_path, run_succeeded
from labtables.operators.samples import missing_outputs


def after_run(
    samples: DataFrame,
    logs: DataFrame,
    files: DataFrame,
    keys: list[str],
    expected: list[str],
    file: str = "file",
    text: str = "text",
) -> DataFrame:
    """Samples with their status after post-processing, and why.

    ``processed`` samples become ``completed`` when their log (one per key) says that
    the run succeeded and names its report, and all expected files are there; else
    ``post_processing_failed``.  All others keep their status.  Logs are reduced to two
    values before they are joined.
    """
    outcome = logs.select(
        *keys, run_succeeded(text).alias("run_succeeded"), report_path(text).alias("report_path")
    )
    checked = missing_outputs(samples, files, keys, file, expected).join(outcome, keys, "left")
    fine = (
        F.coalesce("run_succeeded", F.lit(False)) & F.col("report_path").isNotNull() & F.col("valid")
    )
    todo = post_process_bucket("status") == "processed"
    after = F.when(todo & fine, F.lit("completed")).when(todo, F.lit("post_processing_failed"))
    return checked.withColumn("status", F.coalesce(after, F.col("status"))).drop("valid")
