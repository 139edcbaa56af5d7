"""Keyed merges into the tracking tables.

The stored table is the large side and a patch the small one.  Rows the patch
touches are found by joining *to* the patch, so a patch under the broadcast
threshold leaves the stored table unshuffled, and a larger one falls back to
shuffled joins.  Only ``upsert_samples``, where both sides give columns, is one full
outer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.functions._cols import ColumnOrName, as_col, blank_to_null, null_to_blank


def last_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the greatest ``seq`` of every key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), seq).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}") for c in rest])


def upsert_docs(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace whole rows; ``patch`` has one row per key."""
    kept = base.join(patch.select(*keys), keys, "left_anti")
    return kept.unionByName(patch.select(*base.columns))


def merge_flowcells(old: ColumnOrName, new: ColumnOrName) -> Column:
    """Union of two flowcell lists of one sample, without duplicates."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(as_col(old), empty), F.coalesce(as_col(new), empty))


def flowcell_union(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The same union over (key.., flowcell) rows."""
    return existing.unionByName(new).distinct()


def upsert_samples(
    base: DataFrame,
    patch: DataFrame,
    keys: list[str],
    now: ColumnOrName | None = None,
    replaced: tuple[str, ...] = (),
) -> DataFrame:
    """Add or update tracked samples.

    Known sample: status replaced, flowcells united, start and end replaced
    only where the patch gives one, everything else (job id too) kept.  New
    sample: the patch with QC "", not delivered, started ``now`` unless the patch
    says when, and blanks for what else it lacks.  Columns named in ``replaced``
    are the patch's wherever it has the sample.

    One full outer join, so each side is read and shuffled once: for a large
    stored table hand in the part that the patch may touch, as snapshots do.
    """
    started = F.lit("") if now is None else as_col(now)
    rest = [c for c in base.columns if c not in keys]
    changes = ["status", "job_id", "start_time", "end_time", "flowcells", *replaced]
    both = base.select(*keys, F.struct(*rest).alias("_old")).join(
        patch.select(*keys, F.struct(*changes).alias("_new")), keys, "full"
    )
    old, new = F.col("_old"), F.col("_new")
    known = old.isNotNull()
    given = F.coalesce(F.size(new["flowcells"]), F.lit(0)) > 0
    nothing = F.lit(None).cast("array<string>")
    values = {
        "status": F.coalesce(new["status"], old["status"], F.lit("pending")),
        "job_id": F.when(known, old["job_id"]).otherwise(null_to_blank(new["job_id"])),
        "start_time": F.coalesce(
            blank_to_null(new["start_time"]), F.when(known, old["start_time"]).otherwise(started)
        ),
        "end_time": F.coalesce(
            blank_to_null(new["end_time"]), F.when(known, old["end_time"]).otherwise(F.lit(""))
        ),
        "flowcells": F.when(known & ~given, old["flowcells"]).otherwise(
            merge_flowcells(F.when(known, old["flowcells"]).otherwise(nothing), new["flowcells"])
        ),
        "qc": F.when(known, old["qc"]).otherwise(F.lit("")),
        "delivered": F.when(known, old["delivered"]).otherwise(F.lit(False)),
    }
    for name in replaced:
        values[name] = F.when(new.isNotNull(), new[name]).otherwise(old[name])
    return both.select(
        *[F.col(c) if c in keys else values.get(c, old[c]).alias(c) for c in base.columns]
    )


def upsert_user_info(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Overwrite (key.., value) entries one by one; a null value becomes ""."""
    clean = patch.withColumn("value", null_to_blank("value"))
    return upsert_docs(base, clean, keys)


def merge_user_info(old: ColumnOrName, new: ColumnOrName) -> Column:
    """The same merge on two role -> (key -> value) maps of one document."""

    def clean(entry: Column) -> Column:
        return F.transform_values(entry, lambda _, value: null_to_blank(value))

    def merge_role(_: Column, left: Column, right: Column) -> Column:
        return F.when(right.isNull(), left).when(left.isNull(), clean(right)).otherwise(
            F.map_zip_with(
                left,
                right,
                lambda key, a, b: F.when(
                    F.map_contains_key(right, key), null_to_blank(b)
                ).otherwise(a),
            )
        )

    return F.map_zip_with(as_col(old), as_col(new), merge_role)


def init_projects(
    incoming: DataFrame, tracking: DataFrame, key: str, status: str = "project_status"
) -> DataFrame:
    """What to do with each incoming project.

    insert (unknown), skip (completed) or sync (anything else); all but skip
    go on.
    """
    known = tracking.select(key, F.col(status).alias("_status"), F.lit(True).alias("_known"))
    action = (
        F.when(F.col("_known").isNull(), F.lit("insert"))
        .when(F.col("_status") == "completed", F.lit("skip"))
        .otherwise(F.lit("sync"))
    )
    return (
        incoming.join(known, key, "left")
        .withColumn("action", action)
        .withColumn("proceed", F.col("action") != "skip")
        .drop("_status", "_known")
    )


def update_field(
    samples: DataFrame,
    patches: DataFrame,
    keys: list[str],
    fields: list[str],
    seq: str,
    now: ColumnOrName,
) -> DataFrame:
    """Set single fields of samples from (key.., field, value, seq) rows.

    The last patch of a field wins.  A status also stamps the start or end
    time by its class, and a blank status is refused.
    """
    usable = patches.where(
        F.col("field").isin(*fields)
        & ((F.col("field") != "status") | (null_to_blank("value") != ""))
    )
    per_field = [
        F.max_by("value", F.when(F.col("field") == name, F.col(seq))).alias(f"_{name}")
        for name in fields
    ]
    given = [F.bool_or(F.col("field") == name).alias(f"_has_{name}") for name in fields]
    wide = usable.groupBy(*keys).agg(*per_field, *given)
    out = samples.join(wide, keys, "left")
    for name in fields:
        value = F.when(F.col(f"_has_{name}"), F.col(f"_{name}")).otherwise(F.col(name))
        out = out.withColumn(name, value)
    if "status" in fields:
        starts = F.coalesce(F.col("_status").isin(*S.STAMPS_START), F.lit(False))
        ends = F.coalesce(F.col("_status").isin(*S.STAMPS_END), F.lit(False))
        out = out.withColumn(
            "start_time", F.when(starts, as_col(now)).otherwise(F.col("start_time"))
        ).withColumn("end_time", F.when(ends, as_col(now)).otherwise(F.col("end_time")))
    return out.select(*samples.columns)


def rejected_patches(
    samples: DataFrame, patches: DataFrame, keys: list[str], fields: list[str] | None = None
) -> DataFrame:
    """Patches for samples that do not exist, blank statuses, and patches of other fields.

    ``fields`` are those that ``update_field`` was given; without it any field will do.
    """
    known = samples.select(*keys, F.lit(True).alias("_known"))
    blank = (F.col("field") == "status") & (null_to_blank("value") == "")
    refused = F.col("_known").isNull() | F.coalesce(blank, F.lit(False))
    if fields is not None:
        refused = refused | ~F.coalesce(F.col("field").isin(*fields), F.lit(False))
    return patches.join(known, keys, "left").where(refused).drop("_known")
