"""The change feed, followed into the tracked projects and samples.

The latest documents are Spark's streaming state.  Those that a batch touches are routed
and checked, and their projects and samples are merged with what is tracked: a new
project is inserted as ongoing, a completed one is left alone, any other has its contacts
and sensitivity brought up to date; a sample keeps the status, job, times, QC and delivery
it is tracked with, and its flowcells are united.

Projects and samples are snapshots laid out by project: a batch reads and rewrites only the
folders of its projects.  Merging the same batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from labtables.functions._cols import ColumnOrName
from labtables.functions.documents import is_sensitive, user_info
from labtables.operators.routing import Rules, route
from labtables.operators.samples import merge_tracking
from labtables.operators.upsert import merge_user_info, upsert_samples
from labtables.plans.intake import complete_documents, intake_samples, rejected_documents
from labtables.sources.readers import parse_docs
from labtables.sources.snapshots import Snapshot
from labtables.streaming.changes import follow_documents, latest_documents

PROJECT = """project_id STRING, projects_reference STRING, project_name STRING, method STRING,
  target STRING, project_status STRING, user_info MAP<STRING, MAP<STRING, STRING>>,
  sensitive BOOLEAN, seq BIGINT"""
SAMPLE = """project_id STRING, sample_id STRING, flowcell STRING, status STRING, job_id STRING,
  start_time STRING, end_time STRING, flowcells ARRAY<STRING>, qc STRING, delivered BOOLEAN,
  seq BIGINT"""
SAMPLE_KEYS = ["project_id", "sample_id"]


def project_table(spark: SparkSession, root: str, buckets: int = 64) -> Snapshot:
    return Snapshot(spark, root, ["project_id"], buckets=buckets)


def sample_table(spark: SparkSession, root: str, buckets: int = 64) -> Snapshot:
    """Samples lie with their project, as they are looked up by it."""
    return Snapshot(spark, root, SAMPLE_KEYS, buckets=buckets, bucket_by=["project_id"])


def _contacts(owner: str, fields: str) -> Column:
    """User info as a map of maps, the form in which it is merged key by key."""
    return F.transform_values(
        user_info(owner, fields),
        lambda _, who: F.create_map(F.lit("email"), who["email"], F.lit("name"), who["name"]),
    )


def project_rows(
    docs: DataFrame, rules: Rules, required: list[str], sample_required: list[str] | None = None
) -> DataFrame:
    """Complete, routed documents as project rows."""
    complete = complete_documents(docs, required, sample_required).select(
        F.col("doc.project_id").alias("project_id"),
        F.col("doc_id").alias("projects_reference"),
        F.col("doc.project_name").alias("project_name"),
        F.col("doc.details.library_construction_method").alias("method"),
        _contacts("doc.order_details.owner", "doc.order_details.fields").alias("user_info"),
        is_sensitive("doc.details.sensitive_data").alias("sensitive"),
        "seq",
    )
    return route(complete, "method", rules)


def merge_projects(incoming: DataFrame, tracked: DataFrame) -> DataFrame:
    """Rows to write: new projects, and open ones brought up to date."""
    known = tracked.select(
        "project_id",
        F.col("project_status").alias("_status"),
        F.col("user_info").alias("_user_info"),
        F.lit(True).alias("_known"),
    )
    joined = incoming.join(known, "project_id", "left").where(
        ~F.coalesce(F.col("_status") == "completed", F.lit(False))
    )
    contacts = F.when(F.col("_known"), merge_user_info("_user_info", "user_info"))
    return joined.select(
        *[c for c in incoming.columns if c != "user_info"],
        F.coalesce("_status", F.lit("ongoing")).alias("project_status"),
        F.coalesce(contacts, F.col("user_info")).alias("user_info"),
    )


def merge_samples(rows: DataFrame, tracked: DataFrame, now: ColumnOrName) -> DataFrame:
    """Rows to write: samples of documents merged with the tracked ones of their projects.

    A tracked status and job id stay, flowcells are united, the latest flowcell and ``seq``
    are the document's; a new sample starts ``now`` with empty QC and undelivered.
    """
    patch = merge_tracking(rows.withColumn("job_id", F.lit("")), tracked, SAMPLE_KEYS)
    patch = patch.withColumns(
        {"start_time": F.lit(None).cast("string"), "end_time": F.lit(None).cast("string")}
    )
    return upsert_samples(tracked, patch, SAMPLE_KEYS, now, replaced=("flowcell", "seq"))


def follow_projects(
    changes: DataFrame,
    rules: Rules,
    required: list[str],
    projects: Snapshot,
    samples: Snapshot,
    checkpoint: str,
    poll_seconds: int | None = None,
    sample_required: list[str] | None = None,
    now: ColumnOrName | None = None,
) -> StreamingQuery:
    """Keep both snapshots up to date with the feed.

    ``now`` is the start of a new sample (the time of the batch by default).  Documents that
    go no further are in :func:`rejected`.
    """
    started = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if now is None else now

    def save(batch: DataFrame, batch_id: int) -> None:
        docs = parse_docs(batch.where("body IS NOT NULL")).persist()
        incoming = project_rows(docs, rules, required, sample_required).persist()
        touched = incoming.select("project_id").distinct()
        tracked = projects.current(only=touched, schema=PROJECT)
        tracked_samples = samples.current(only=touched, schema=SAMPLE)
        going = merge_projects(incoming, tracked).persist()
        try:
            rows = intake_samples(docs, all_flowcells=True).join(
                going.select("project_id", "seq"), "project_id"
            )
            samples.upsert(merge_samples(rows, tracked_samples, started), batch_id)
            projects.upsert(going, batch_id)
        finally:
            for cached in (going, incoming, docs):
                cached.unpersist()

    return follow_documents(changes, checkpoint, save, poll_seconds)


def rejected(
    spark: SparkSession,
    checkpoint: str,
    rules: Rules,
    required: list[str],
    sample_required: list[str] | None = None,
) -> DataFrame:
    """Latest documents that go no further, with the reason; a mended one is gone from here."""
    docs = parse_docs(latest_documents(spark, checkpoint).where("body IS NOT NULL"))
    return rejected_documents(docs, rules, required, sample_required)
