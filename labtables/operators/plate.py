"""Plate report tables, for all plates at once, keyed by (plate, barcode)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.functions.plates import well_index


def wells_for_set(lookup: DataFrame, barcode_set: str, reagent: str = "1.5") -> DataFrame:
    """(barcode, well) rows of one barcode set."""
    barcode = S.REAGENT_COLUMN.get(reagent, "XC")
    return lookup.where(F.col("BCset") == barcode_set).select(
        F.col(barcode).alias("barcode"), F.col("WellID").alias("well")
    )


def wells_for_plates(
    plates: DataFrame,
    lookup: DataFrame,
    plate: str = "plate",
    barcode_set: str = "barcode_set",
    reagent: str = "1.5",
) -> DataFrame:
    """(plate, barcode, well) rows of every plate, by its barcode set."""
    barcode = S.REAGENT_COLUMN.get(reagent, "XC")
    wells = lookup.select(
        F.col("BCset").alias("_set"),
        F.col(barcode).alias("barcode"),
        F.col("WellID").alias("well"),
    )
    return plates.join(wells, F.col(barcode_set) == F.col("_set")).select(
        plate, "barcode", "well"
    )


def pivot_types(
    long: DataFrame,
    keys: list[str],
    type_column: str,
    value: str,
    types: dict[str, str],
    with_total: str | None = None,
) -> DataFrame:
    """One column per declared type (type -> column name), missing = 0.

    A conditional sum per type in one aggregate: one shuffle, reduced on the
    map side, where a two-step pivot needs two.  ``with_total`` adds the sum
    over all types, declared or not.
    """
    number = F.coalesce(F.col(value), F.lit(0))
    sums = [
        F.sum(F.when(F.col(type_column) == F.lit(name), number).otherwise(F.lit(0))).alias(column)
        for name, column in types.items()
    ]
    if with_total:
        sums.append(F.sum(number).alias(with_total))
    return long.groupBy(*keys).agg(*sums)


def total_reads(long: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Sum over all types of a long stats table."""
    return long.groupBy(*keys).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias(out))


def join_stats(wells: DataFrame, stats: list[DataFrame], keys: list[str]) -> DataFrame:
    """Wells with each stats table joined to the left.

    Every stats table must have one row per key.  They share the key, so each
    is shuffled once and the joins in between reuse that partitioning.
    """
    out = wells
    for table in stats:
        out = out.join(table, keys, "left")
    return out


def cell_counts(cells: DataFrame, counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Per cell: summed count and number of genes with a non-zero count.

    ``cells`` lists all cells, so that all-zero ones survive.
    """
    value = F.coalesce(F.col(count), F.lit(0))
    per_cell = counts.groupBy(*keys).agg(
        F.sum(value).alias("umi_reads"), F.count_if(value != 0).alias("umi_genes")
    )
    return cells.join(per_cell, keys, "left").select(
        *[c for c in cells.columns],
        F.coalesce("umi_reads", F.lit(0)).alias("umi_reads"),
        F.coalesce("umi_genes", F.lit(0)).alias("umi_genes"),
    )


def array_cell_counts(cell_arrays: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """:func:`cell_counts` when each cell's counts are one array: no shuffle."""
    zero = F.lit(0).cast("long")
    total = F.aggregate(counts, zero, lambda acc, x: acc + F.coalesce(x, zero).cast("long"))
    nonzero = F.size(F.filter(counts, lambda x: x != 0)).cast("long")
    return cell_arrays.select(*keys, total.alias("umi_reads"), nonzero.alias("umi_genes"))


def plates_of_all(tables: list[DataFrame], plate: str) -> DataFrame:
    """Plates that have rows in every one of the tables.

    Which tables a plate is in is one number per plate, reduced on the map side and brought
    together in one aggregate, whatever the number of tables.
    """
    seen = [table.select(plate, F.lit(1 << k).alias("_in")) for k, table in enumerate(tables)]
    found = seen[0]
    for more in seen[1:]:
        found = found.union(more)
    found = found.groupBy(plate).agg(F.bit_or("_in").alias("_in"))
    return found.where(F.col("_in") == (1 << len(tables)) - 1).select(plate)


def join_counts(
    stats: DataFrame,
    counts: DataFrame,
    plate: str,
    keys: list[str],
    stats_plates: DataFrame | None = None,
    counts_plates: DataFrame | None = None,
) -> DataFrame:
    """Stats and cell counts, full outer on the barcode.

    A plate takes part only when both tables have rows for it.  Where the plates
    of a table are known from something smaller, pass that.  Each table is
    joined once; the plates are filtered afterwards, by one small table.
    """
    both = plates_of_all(
        [stats if stats_plates is None else stats_plates, counts if counts_plates is None else counts_plates],
        plate,
    )
    return stats.join(counts, keys, "full").join(both, plate, "left_semi")


def reads_summary(
    reads: str, unit: int = 1_000_000, wells: int = S.PLATE_WELLS
) -> tuple[Column, Column]:
    """Whole millions of reads (an aggregate), and thousands per well from those.

    The average is taken from the truncated millions over the fixed number of
    wells and rounded half to even.
    """
    filtered = F.floor(F.sum(reads) / F.lit(unit)).cast("long").alias("filtered_reads_m")
    average = F.bround(F.col("filtered_reads_m") / F.lit(wells) * F.lit(1000), 2)
    return filtered, average.alias("avg_reads_per_cell_k")


def plate_overview(
    stats: DataFrame,
    plate: str,
    reads: str,
    unit: int = 1_000_000,
    wells: int = S.PLATE_WELLS,
) -> DataFrame:
    """Reads per plate in whole millions and thousands of reads per well."""
    filtered, average = reads_summary(reads, unit, wells)
    return stats.groupBy(plate).agg(filtered).select(plate, "filtered_reads_m", average)


def null_counts(columns: list[str]) -> list[Column]:
    """Aggregates: null values, and all values, over the given columns."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return [
        nulls.cast("long").alias("n_nulls"),
        (F.count("*") * len(columns)).alias("n_values"),
    ]


def null_percent() -> Column:
    return F.try_divide(F.col("n_nulls"), F.col("n_values")) * 100


def passes_gate(limit: float = S.NULL_SHARE_LIMIT) -> Column:
    return F.coalesce(null_percent() <= F.lit(limit), F.lit(True))


def null_share(
    df: DataFrame, keys: list[str], columns: list[str], limit: float = S.NULL_SHARE_LIMIT
) -> DataFrame:
    """Percentage of null values over all given columns; fails above the limit."""
    return (
        df.groupBy(*keys)
        .agg(*null_counts(columns))
        .withColumn("null_percent", null_percent())
        .withColumn("passes", passes_gate(limit))
    )


def plate_grid(
    values: DataFrame, plate: str, well: str, ordinal: str, columns: list[str]
) -> DataFrame:
    """All 384 wells of every plate; absent wells are 0, the last row of a well wins.

    Rows without a readable well are skipped.  ``columns`` are numbers, so the
    last value per well is kept in a hash aggregate.
    """
    last = (
        values.withColumn("_index", well_index(well))
        .where("_index IS NOT NULL")
        .groupBy(plate, "_index")
        .agg(*[F.max_by(c, ordinal).alias(c) for c in columns])
    )
    wells = (
        values.select(plate)
        .distinct()
        .withColumn("_index", F.explode(F.sequence(F.lit(0), F.lit(S.PLATE_WELLS - 1))))
    )
    return wells.join(last, [plate, "_index"], "left").select(
        plate,
        F.floor(F.col("_index") / S.PLATE_COLUMNS).cast("int").alias("row"),
        F.pmod("_index", F.lit(S.PLATE_COLUMNS)).cast("int").alias("col"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns],
    )


def log_scaled(value: Column, log: bool) -> Column:
    """log2 when asked; null for zero, which has none."""
    return F.when(value > 0, F.log2(value)) if log else value


def scaled_size(
    grid: DataFrame,
    plate: str,
    value: str,
    log: bool = False,
    size_range: tuple[float, float] = S.SIZE_RANGE,
    out: str = "size",
) -> DataFrame:
    """Dot size of every well, min-max scaled over its plate.

    The window is over one grid, 384 rows.  Null when all wells are equal.
    """
    low, high = size_range
    over_plate = W.partitionBy(plate)
    v = F.col("_v")
    lowest, highest = F.min(v).over(over_plate), F.max(v).over(over_plate)
    share = F.try_divide(v - lowest, highest - lowest)
    return (
        grid.withColumn("_v", log_scaled(F.col(value), log).cast("double"))
        .withColumn(out, share * (high - low) + low)
        .drop("_v")
    )


def size_legend(grid: DataFrame, plate: str, value: str, log: bool = False) -> DataFrame:
    """Legend values of a plate: smallest, half of the largest, largest."""
    v = log_scaled(F.col(value), log)
    return grid.groupBy(plate).agg(
        F.min(v).cast("long").alias("legend_min"),
        (F.max(v) / 2).cast("long").alias("legend_mid"),
        F.max(v).cast("long").alias("legend_max"),
    )
