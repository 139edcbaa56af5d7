"""Readers.  Every schema is declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtables import schemas as S
from labtables.functions.text import base_name


def parse_docs(raw: DataFrame, schema: str = S.PROJECT_DOC, body: str = "body") -> DataFrame:
    """Adds the typed document as ``doc`` and the untyped one as ``variant``.

    The untyped form is kept because an absent field and a null one differ when
    required fields are checked; where it is not used it is not parsed.  The
    typed form is exploded from a one-element array, which makes it a column of
    its own: later filters and expressions read it instead of parsing again.
    """
    return raw.select(
        "*",
        F.try_parse_json(body).alias("variant"),
        F.explode(F.array(F.from_json(body, schema))).alias("doc"),
    )


def typed(docs: DataFrame, *keep: str) -> DataFrame:
    """The typed document's fields as top-level columns."""
    return docs.select(*keep, "doc.*")


def read_docs(spark: SparkSession, path: str, schema: str = S.PROJECT_DOC) -> DataFrame:
    """Project documents from JSON lines, one row each: id, text, typed, untyped."""
    raw = spark.read.text(path).select(
        F.get_json_object("value", "$._id").alias("doc_id"), F.col("value").alias("body")
    )
    return parse_docs(raw, schema)


def malformed_docs(docs: DataFrame, body: str = "body") -> DataFrame:
    """Documents whose text is no JSON object: a table of rejects."""
    return docs.where(_malformed(body))


def well_formed_docs(docs: DataFrame, body: str = "body") -> DataFrame:
    return docs.where(~_malformed(body))


def _malformed(body: str) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(body))
    return ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def lookup_doc(docs: DataFrame, doc_id: str | int, key: str = "doc_id") -> DataFrame:
    """One document by id; the filter reaches the scan."""
    return docs.where(F.col(key) == F.lit(doc_id))


def existing_docs(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose id is asked for.

    Ids are made distinct first, so one asked for very often is one row.
    """
    return docs.join(ids.select(key).distinct(), key, "left_semi")


def path_part(path: Column, from_end: int) -> Column:
    """A folder name of a path, counted from the end (1 = file name)."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def _lines_by_name(
    spark: SparkSession, path: str, names: list[str], sep: str, *keep: Column
) -> tuple[DataFrame, DataFrame]:
    """Delimited files read by the names in each file's own header.

    Returns (kept columns, named columns as text), a row per data line, and the
    kept columns of the files that are empty or whose header lacks a name.
    Columns in any order and further ones do no harm.  A file (one plate's
    statistics, or a lookup) is read whole, so its header is known to its lines.
    """
    kept = [f"_k{i}" for i in range(len(keep))]
    unquoted = r'^"|"$'
    files = spark.read.text(path, wholetext=True).select(
        *[column.alias(name) for column, name in zip(keep, kept, strict=True)],
        F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "").alias("_lines"),
    )
    header = F.transform(
        F.split(F.coalesce(F.get("_lines", F.lit(0)), F.lit("")), sep),
        lambda name: F.regexp_replace(F.trim(name), unquoted, ""),
    )
    files = files.withColumn("_header", header)
    fine = F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains("_header", n))
    unusable = files.where(~fine | (F.size("_lines") < 2)).select(*kept)
    lines = files.where(fine).select(
        *kept, "_header", F.explode(F.slice("_lines", 2, F.size("_lines"))).alias("_line")
    )
    cells = F.split("_line", sep)
    values = [
        F.nullif(
            F.regexp_replace(
                F.get(cells, (F.array_position("_header", n) - 1).cast("int")), unquoted, ""
            ),
            F.lit(""),
        ).alias(n)
        for n in names
    ]
    return lines.select(*kept, *values), unusable


def read_long_stats(
    spark: SparkSession, path: str, kind: str, plate_level: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Tab-separated stats files of one kind, and the plates that must fail.

    Columns are found by the names in each file's header.  The plate is a folder
    of the file's path, ``plate_level`` from the end.  A plate fails when a file
    of it has no data line or lacks a column, or when any line has no barcode or
    text where a number belongs; its other lines are left out.  Spark skips files
    of no bytes: ``plate_report.failed_plates`` finds plates without any rows.
    """
    schema = T.StructType.fromDDL(S.LONG_STATS[kind])
    plate = path_part(F.col("_metadata.file_path"), plate_level)
    lines, unusable = _lines_by_name(spark, path, schema.names, "\t", plate)
    values = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]
    bad = F.col(schema[0].name).isNull()
    for f in schema:
        bad = bad | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    rows = lines.select(F.col("_k0").alias("plate"), *values, bad.alias("_bad"))
    failed = rows.where("_bad").select("plate").union(unusable).distinct()
    stats = rows.where("NOT _bad").drop("_bad").join(failed, "plate", "left_anti")
    return stats, failed


def read_barcode_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The barcode dimension from comma-separated files, columns found by name.

    A file that lacks a column is an error: there is no plate to fail for it.
    """
    schema = T.StructType.fromDDL(S.BARCODE_LOOKUP)
    lines, unusable = _lines_by_name(spark, path, schema.names, ",", F.col("_metadata.file_path"))
    broken = [row[0] for row in unusable.limit(5).collect()]
    if broken:
        raise ValueError(f"lookup files without the columns {schema.names}: {broken}")
    return lines.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_count_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long count matrix: one row per (plate, cell, gene)."""
    return spark.read.schema(S.COUNT_MATRIX).parquet(path)


def explode_counts(cells: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """Long count matrix from one count array per cell; gene = array position."""
    return cells.select(*keys, F.posexplode(counts).alias("gene", "count"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """File inventory under a root; the contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length", "modificationTime")
    )


def fastq_folders(files: DataFrame, path: str = "path") -> DataFrame:
    """(project, sample, flowcell, folder) of files below project/sample/run/flowcell."""
    parts = F.split(F.col(path), "/")

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(-i))

    return (
        files.select(
            part(5).alias("project_id"),
            part(4).alias("sample_id"),
            part(2).alias("flowcell"),
            F.left(F.col(path), F.length(path) - F.length(base_name(path)) - 1).alias("folder"),
        )
        .where("project_id IS NOT NULL")
        .distinct()
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole log texts with their paths."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of logs of any length: path, place, line; ``place`` orders a log's lines.

    Unlike whole texts, a log is read in as many splits as it has blocks: a line's place is
    that of its block in the file, then its own in the block.
    """
    lines = spark.read.text(path, lineSep="\n")
    place = F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select(
        F.col("_metadata.file_path").alias("path"), place.alias("place"), F.col("value").alias("line")
    )
