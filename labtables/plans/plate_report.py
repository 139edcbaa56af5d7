"""The plate report for all plates: stats, gate, overview, grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtables.functions.status import good_barcode
from labtables.operators import plate as P

KEYS = ["plate", "barcode"]


@dataclass(frozen=True)
class PlateInputs:
    """Input tables, each keyed by (plate, barcode).

    ``plates`` (plate, barcode_set), ``lookup`` the barcode dimension, ``reads``
    and ``genes`` long (barcode, n, type), ``umi`` one row per barcode,
    ``cells`` all cells of the matrix and ``counts`` its long form.  ``failed``
    (plate) are the plates with unusable files, as the readers return them.
    """

    plates: DataFrame
    lookup: DataFrame
    reads: DataFrame
    genes: DataFrame
    umi: DataFrame
    cells: DataFrame
    counts: DataFrame
    failed: DataFrame | None = None


def failed_plates(inputs: PlateInputs) -> DataFrame:
    """Plates that get no report: with unusable files, or without rows of some kind.

    Which kinds a plate has is one number per plate, brought together in one aggregate.
    """
    kinds = (inputs.reads, inputs.genes, inputs.umi)
    seen = [
        kind.select("plate", F.lit(1 << k).alias("_kinds"), F.lit(False).alias("_unusable"))
        for k, kind in enumerate(kinds)
    ]
    if inputs.failed is not None:
        seen.append(
            inputs.failed.select("plate", F.lit(0).alias("_kinds"), F.lit(True).alias("_unusable"))
        )
    found = seen[0]
    for more in seen[1:]:
        found = found.union(more)
    found = found.groupBy("plate").agg(
        F.bit_or("_kinds").alias("_kinds"), F.bool_or("_unusable").alias("_unusable")
    )
    lacking = F.coalesce("_kinds", F.lit(0)) != (1 << len(kinds)) - 1
    return (
        inputs.plates.select("plate")
        .distinct()
        .join(found, "plate", "left")
        .where(lacking | F.coalesce("_unusable", F.lit(False)))
        .select("plate")
    )


def plate_stats(inputs: PlateInputs, gene_types: dict[str, str], reagent: str = "1.5") -> DataFrame:
    """One row per well with all its statistics; failed plates have none.

    The wide tables meet in one chain of joins on the same key; which plates stay is settled
    from plate numbers alone, in one aggregate over all kinds, and applied once, at the end.
    """
    wells = P.wells_for_plates(inputs.plates, inputs.lookup, reagent=reagent)
    reads = P.total_reads(inputs.reads.where(good_barcode("barcode")), KEYS, "n", "total_reads")
    genes = P.pivot_types(inputs.genes, KEYS, "type", "n", gene_types)
    stats = P.join_stats(wells, [reads, inputs.umi, genes], KEYS)
    counts = P.cell_counts(inputs.cells, inputs.counts, KEYS, "count")
    usable = P.plates_of_all([wells, inputs.reads, inputs.genes, inputs.umi], "plate")
    if inputs.failed is not None:
        usable = usable.join(inputs.failed, "plate", "left_anti")
    return P.join_counts(stats, counts, "plate", KEYS, usable, inputs.cells)


def overview(stats: DataFrame, unit: int = 1_000_000) -> DataFrame:
    """Overview of the plates whose share of nulls is within the limit.

    The gate and the overview come from the same pass over the stats.
    """
    columns = [c for c in stats.columns if c not in KEYS]
    filtered, average = P.reads_summary("total_reads", unit)
    plates = stats.groupBy("plate").agg(filtered, *P.null_counts(columns))
    return plates.where(P.passes_gate()).select("plate", "filtered_reads_m", average)


def grids(stats: DataFrame, reads: str, size: str) -> DataFrame:
    """The 384-well grid of every plate with its colour, size and dot size."""
    grid = P.plate_grid(stats, "plate", "well", "barcode", [reads, size])
    return P.scaled_size(grid, "plate", size)
