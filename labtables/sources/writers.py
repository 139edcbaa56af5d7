"""Writers.

Files are grouped by plate or run sample.  The ``rebalance`` hint brings the
rows of one group together but lets adaptive execution split a group that is
too large for one task, so a hot group becomes several files, not one slow task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stats_tsv(
    stats: DataFrame, path: str, plate: str, barcode: str, columns: list[str]
) -> None:
    """Selected columns keyed by barcode, tab-separated, one folder per plate."""
    (
        stats.select(plate, barcode, *columns)
        .hint("rebalance", plate)
        .write.mode("overwrite")
        .partitionBy(plate)
        .options(sep="\t", header=True, emptyValue="", nullValue="")
        .csv(path)
    )


def write_barcode_list(wells: DataFrame, path: str, barcode: str = "barcode") -> None:
    """Barcodes of one set, no header."""
    wells.select(barcode).write.mode("overwrite").options(header=False).csv(path)


def write_libraries(rows: DataFrame, path: str, run_sample: str) -> None:
    """Library sheet (fastqs, sample, library_type), one folder per run sample."""
    (
        rows.select(run_sample, "fastqs", "sample", "library_type")
        .hint("rebalance", run_sample)
        .write.mode("overwrite")
        .partitionBy(run_sample)
        .options(header=True)
        .csv(path)
    )


def multi_sheet_lines(
    run_samples: DataFrame,
    libraries: DataFrame,
    references: DataFrame,
    run_sample: str,
    sections: list[tuple[str, str | None, list[str]]],
) -> DataFrame:
    """Lines (run_sample, section_no, line_no, line) of the sectioned run sheet.

    ``sections`` are (name, reference key or None, argument lines).  A section
    has its name, its reference when the run sample has one, its arguments and
    a blank line; the libraries section comes last.  ``references`` is
    (run_sample, ref_key, ref_path), one row per key.
    """
    head_rows = [
        F.struct(F.lit(i).alias("section_no"), F.lit(j).alias("line_no"), F.lit(text).alias("line"))
        for i, (name, _, arguments) in enumerate(sections)
        for j, text in [(0, f"[{name}]")]
        + [(2 + k, a) for k, a in enumerate(arguments)]
        + [(2 + len(arguments), "")]
    ]
    last = len(sections)
    head_rows += [
        F.struct(F.lit(last).alias("section_no"), F.lit(j).alias("line_no"), F.lit(text).alias("line"))
        for j, text in enumerate(["[libraries]", "fastq_id,fastqs,feature_types"])
    ]
    fixed = run_samples.select(run_sample, F.inline(F.array(*head_rows))).select(
        run_sample, "section_no", "line_no", "line", F.lit("").alias("_order")
    )
    keyed = [
        F.when(F.col("ref_key") == key, F.lit(i))
        for i, (_, key, _) in enumerate(sections)
        if key is not None
    ]
    parts = [fixed]
    if keyed:
        parts.append(
            references.where("ref_path IS NOT NULL").select(
                run_sample,
                F.explode(F.array_compact(F.array(*keyed))).alias("section_no"),
                F.lit(1).alias("line_no"),
                F.concat(F.lit("reference,"), "ref_path").alias("line"),
                F.lit("").alias("_order"),
            )
        )
    rows = F.concat_ws(",", "sample", "fastqs", "library_type")
    parts.append(
        libraries.select(
            run_sample,
            F.lit(last).alias("section_no"),
            F.lit(2).alias("line_no"),
            rows.alias("line"),
            rows.alias("_order"),
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_multi_sheet(
    lines: DataFrame, path: str, run_sample: str, max_lines: int = 1_000_000
) -> None:
    """One folder per run sample; its files, in name order, are the sheet.

    A sheet of up to ``max_lines`` lines is one file.  Only a longer one is cut, at
    ranges of its lines, so that none has to pass through one task.
    """
    order = ["section_no", "line_no", "_order"]
    long = lines.groupBy(run_sample).agg((F.count("*") > max_lines).alias("_long"))
    # Lines of a sheet that is not long are equal here, and equal values stay together.
    cuts = [F.when(F.col("_long"), F.col(name)) for name in order]
    (
        lines.join(long, run_sample)
        .repartitionByRange(run_sample, *cuts)
        .sortWithinPartitions(run_sample, *order)
        .select(run_sample, "line")
        .write.mode("overwrite")
        .partitionBy(run_sample)
        .text(path)
    )
