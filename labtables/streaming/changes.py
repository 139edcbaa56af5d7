"""The change feed: follow it, keep the latest documents, route them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from labtables import schemas as S
from labtables.functions.status import rollup_status
from labtables.operators.lifecycle import summarise_samples
from labtables.operators.routing import Rules, with_target


def read_changes(
    spark: SparkSession,
    path: str,
    schema: str = S.RAW_DOC,
    fmt: str = "parquet",
    max_files: int | None = None,
    since: int | None = None,
    seq: str = "seq",
) -> DataFrame:
    """The feed as a stream of files.

    The checkpoint of the query that reads it remembers what was processed; a
    new checkpoint starts from the beginning, or after the change ``since``: the
    test reaches the scan, so older row groups are not read.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    changes = reader.load(path)
    return changes if since is None else changes.where(F.col(seq) > since)


def run(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    poll_seconds: int | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Start a query: all that is there and stop, or poll for ever."""
    writer = (
        stream.writeStream.foreachBatch(each_batch)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
    )
    if poll_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{poll_seconds} seconds").start()


def latest_changes(changes: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Each changed document once, as it is after its last change.

    A document whose last change deleted it (null body) is not handed on, whatever
    it was before.
    """
    last = changes.groupBy(key).agg(F.max_by("body", seq).alias("body"), F.max(seq).alias(seq))
    return last.where("body IS NOT NULL")


def read_state(spark: SparkSession, checkpoint: str, value: str) -> DataFrame:
    """What a streaming aggregate holds after its last batch: its keys and the struct ``value``.

    Spark's state reader names aggregates by their function; ``value`` (DDL) names them by
    their order.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value").cast(value).alias("value")).select("*", "value.*").drop("value")


def _each(on_change: Callable[[DataFrame, int], None] | None) -> Callable[[DataFrame, int], None]:
    """A batch writer; the batch is worked out once, whatever is done with it."""

    def save(batch: DataFrame, batch_id: int) -> None:
        if on_change is None:
            batch.write.format("noop").mode("append").save()
            return
        # Documents differ much in size: dealt out anew before they are worked on.
        parts = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        batch = batch.repartition(parts).persist()
        try:
            batch.count()  # the state is kept even if the handler reads nothing
            on_change(batch, batch_id)
        finally:
            batch.unpersist()

    return save


def latest_state(changes: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Streaming aggregate: each document as it is after its last change."""
    last = F.max(F.struct(F.col(seq).alias("seq"), F.col("body").alias("body")))
    return changes.groupBy(key).agg(last.alias("last")).select(key, "last.seq", "last.body")


def follow_documents(
    changes: DataFrame,
    checkpoint: str,
    on_change: Callable[[DataFrame, int], None] | None = None,
    poll_seconds: int | None = None,
) -> StreamingQuery:
    """Keep the latest document per id in Spark's state store.

    ``on_change`` gets the documents that a batch touched, as they are now; a deleted one has
    a null body, and an older version of it does not come back.  A batch costs what it changes,
    not what is kept.  A batch may be handed on again after a failure.
    """
    return run(latest_state(changes), _each(on_change), checkpoint, poll_seconds, "update")


def latest_documents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All documents followed so far (doc_id, seq, body), deleted ones with a null body."""
    held = read_state(spark, checkpoint, "struct<last: struct<seq: bigint, body: string>>")
    return held.select(*[c for c in held.columns if c != "last"], "last.*")


def _targeted(docs: DataFrame, rules: Rules, method_path: str) -> DataFrame:
    """Documents that are not deleted, with method and target (null if unknown)."""
    method = F.get_json_object("body", method_path).alias("method")
    return with_target(docs.where("body IS NOT NULL").select("*", method), "method", rules)


def follow_routed(
    changes: DataFrame,
    rules: Rules,
    method_path: str,
    checkpoint: str,
    on_change: Callable[[DataFrame, int], None] | None = None,
    poll_seconds: int | None = None,
) -> StreamingQuery:
    """:func:`follow_documents` that hands on documents with their target.

    Unknown methods have a null target.  Which document is where at any time is in
    :func:`routed_documents`.
    """

    def routed(batch: DataFrame, batch_id: int) -> None:
        on_change(_targeted(batch, rules, method_path), batch_id)

    return follow_documents(changes, checkpoint, on_change and routed, poll_seconds)


def routed_documents(
    spark: SparkSession, checkpoint: str, rules: Rules, method_path: str
) -> tuple[DataFrame, DataFrame]:
    """Latest documents with their target, and those of unknown methods."""
    docs = _targeted(latest_documents(spark, checkpoint), rules, method_path)
    return docs.where("target IS NOT NULL"), docs.where("target IS NULL").drop("target")


def status_state(log: DataFrame, keys: list[str], status: str, seq: str, ts: str) -> DataFrame:
    """Streaming aggregate: status of each sample, and when it last started and ended."""
    value = F.col(status)
    return log.groupBy(*keys).agg(
        F.max(F.struct(F.col(seq).alias("seq"), value.alias("status"))).alias("last"),
        F.max(F.when(value.isin(*S.STAMPS_START), F.col(ts))).alias("start_time"),
        F.max(F.when(value.isin(*S.STAMPS_END), F.col(ts))).alias("end_time"),
    ).select(*keys, "last.status", "start_time", "end_time", "last.seq")


def follow_status(
    log: DataFrame,
    keys: list[str],
    status: str,
    seq: str,
    ts: str,
    checkpoint: str,
    on_change: Callable[[DataFrame, int], None] | None = None,
    poll_seconds: int | None = None,
) -> StreamingQuery:
    """Keep each sample's current status, start and end as status rows arrive.

    The state is that of partial aggregates, so batches may come in any order and a late row
    changes nothing it should not.  ``on_change`` gets the samples that a batch touched.
    """
    held = status_state(log, keys, status, seq, ts)
    return run(held, _each(on_change), checkpoint, poll_seconds, "update")


def current_statuses(spark: SparkSession, checkpoint: str, ts_type: str = "timestamp") -> DataFrame:
    """All samples followed so far: keys, status, start_time, end_time, seq."""
    last = "last: struct<seq: bigint, status: string>"
    held = read_state(
        spark, checkpoint, f"struct<{last}, start_time: {ts_type}, end_time: {ts_type}>"
    )
    keys = [c for c in held.columns if c not in ("last", "start_time", "end_time")]
    return held.select(*keys, "last.status", "start_time", "end_time", "last.seq")


def tracked_projects(
    samples: DataFrame, project: str, finished_as: str = "completed"
) -> DataFrame:
    """Project statuses rolled up from tracked samples."""
    flags = summarise_samples(samples, project, status="status")
    status = rollup_status("any_active", "all_finished", "all_not_started", finished_as)
    return flags.select(project, "n_samples", status.alias("project_status"))
