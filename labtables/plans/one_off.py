"""Run the intake for a single document, outside the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labtables.operators.routing import Rules
from labtables.plans.intake import intake_projects
from labtables.sources.readers import lookup_doc


def run_once(
    docs: DataFrame, doc_id: str, rules: Rules, required: list[str], tracking: DataFrame
) -> DataFrame:
    """Same result as the stream gives for this document; empty when unknown."""
    return intake_projects(lookup_doc(docs, doc_id), rules, required, tracking)
