"""Statuses of samples and projects over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.functions.status import rollup_status


def status_flags(status: str = "status") -> list[Column]:
    """The three roll-up flags, as aggregates of a project's samples.

    A missing status is in none of the classes.
    """
    value = F.coalesce(F.col(status), F.lit(""))
    return [
        F.bool_or(value.isin(*S.ROLLUP_ACTIVE)).alias("any_active"),
        F.bool_and(value.isin(*S.ROLLUP_FINISHED)).alias("all_finished"),
        F.bool_and(value.isin(*S.ROLLUP_NOT_STARTED)).alias("all_not_started"),
    ]


def qc_flags(qc: str = "qc") -> list[Column]:
    """The four quality flags, as aggregates of a project's samples."""
    value = F.coalesce(F.col(qc), F.lit(""))
    return [
        F.bool_or(value == "Pending").alias("any_pending"),
        F.bool_or(value == "Passed").alias("any_passed"),
        F.bool_and(value.isin("Passed", "Aborted")).alias("all_passed_or_aborted"),
        F.bool_and(value == "Aborted").alias("all_aborted"),
    ]


def summarise_samples(
    samples: DataFrame, key: str, status: str | None = None, qc: str | None = None
) -> DataFrame:
    """Status and quality flags of every project, in one aggregate.

    Only booleans and a count are shuffled, one row per project and map task.
    """
    flags = [F.count("*").alias("n_samples")]
    flags += status_flags(status) if status else []
    flags += qc_flags(qc) if qc else []
    return samples.groupBy(key).agg(*flags)


def project_rollup(
    projects: DataFrame,
    samples: DataFrame,
    key: str,
    status: str = "status",
    outputs: dict[str, str] | None = None,
) -> DataFrame:
    """Every project with its rolled-up status, also those without samples.

    ``outputs`` maps an output column to the word used for "all finished".
    """
    outputs = outputs or {"project_status": "completed"}
    flags = summarise_samples(samples, key, status=status)
    joined = projects.join(flags, key, "left")
    statuses = [
        rollup_status("any_active", "all_finished", "all_not_started", word).alias(name)
        for name, word in outputs.items()
    ]
    return joined.select(*projects.columns, *statuses)


def realm_supports_auto(samples: DataFrame, key: str, auto: str) -> DataFrame:
    """Whether every sample of a group may be submitted by itself.

    A sample without the flag may not.  Groups without samples are absent; read
    them as true.
    """
    flag = F.bool_and(F.coalesce(F.col(auto), F.lit(False))).alias("realm_auto")
    return samples.groupBy(key).agg(flag)


def counts_by_bucket(
    samples: DataFrame, key: str, bucket: Column, buckets: list[str]
) -> DataFrame:
    """One count column per bucket and project.

    The buckets are declared, so this is a single aggregate.
    """
    return samples.groupBy(key).agg(
        *[F.count_if(bucket == name).alias(f"n_{name}") for name in buckets]
    )


def current_status(
    log: DataFrame, keys: list[str], status: str, seq: str, ts: str
) -> DataFrame:
    """Last status of every sample, and when it last started and ended.

    ``seq`` orders the log.  Works by partial aggregation, so a sample with
    very many log rows is reduced before it is shuffled.
    """
    value = F.col(status)
    return log.groupBy(*keys).agg(
        F.max_by(status, seq).alias("status"),
        F.max(F.when(value.isin(*S.STAMPS_START), F.col(ts))).alias("start_time"),
        F.max(F.when(value.isin(*S.STAMPS_END), F.col(ts))).alias("end_time"),
    )


def project_end_date(
    log: DataFrame,
    key: str,
    status: str,
    seq: str,
    ts: str,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """When each project was finished, null if it was reopened since.

    Finishing sets the date once; going back to work clears it; other statuses
    leave it.  So the date is that of the first finishing row after the last
    clearing row.  ``seq`` is a unique number that orders the log.

    A project's log is cut into chunks of ``chunk_rows`` sequence numbers, and a chunk is
    summed up by whether it clears, and the first finishing row after that.  Two neighbours
    make one summary of the same form: the right one if it clears, else the left one's
    date or, without any, the right one's.  So the log is read once, a list holds the
    rows of one chunk at most, and per project only summaries are brought together.
    ``labtables.streaming.rollup`` carries the same summary from batch to batch.
    """
    value = F.col(status)
    clears, sets = value.isin(*S.CLEARS_END_DATE), value.isin(*S.SETS_END_DATE)
    fact = F.struct(F.col(seq).alias("seq"), F.col(ts).alias("ts"), clears.alias("clears"))
    chunks = (
        log.select(
            key,
            F.expr(f"`{seq}` div {int(chunk_rows)}").alias("_chunk"),
            F.when(clears | sets, fact).alias("_fact"),
        )
        .groupBy(key, "_chunk")
        .agg(F.collect_list("_fact").alias("_facts"))
        .withColumn(
            "_cleared",
            F.array_max(F.transform(F.filter("_facts", lambda f: f["clears"]), lambda f: f["seq"])),
        )
    )
    cleared = F.col("_cleared")
    after = F.filter(
        "_facts", lambda f: ~f["clears"] & (cleared.isNull() | (f["seq"] > cleared))
    )
    summary = F.struct(
        "_chunk", cleared.isNotNull().alias("clears"), F.array_min(after)["ts"].alias("ts")
    )
    in_order = F.array_sort(F.collect_list(summary))
    date = F.aggregate(
        "_chunks",
        F.lit(None).cast(log.schema[ts].dataType),
        lambda held, part: F.when(part["clears"], part["ts"]).otherwise(F.coalesce(held, part["ts"])),
    )
    return (
        chunks.groupBy(key).agg(in_order.alias("_chunks")).select(key, date.alias("end_date"))
    )
