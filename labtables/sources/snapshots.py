"""Keyed snapshots: one row per key, in folders by a hash of the key.

A merge reads and rewrites the folders its keys fall into, and no other, by Spark's dynamic
partition overwrite.  What a folder becomes is first written whole next to it, so a job that
fails while folders are being replaced finds all of it there and replaces them again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"


class Snapshot:
    """The newest row of every key, the greatest ``seq`` winning.

    ``buckets`` is fixed when the first row is written; a bucket should hold some hundred
    megabytes.  ``bucket_by`` names the key columns that place a row (all by default): rows
    looked up by fewer columns should be placed by those.  One job writes at a time.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        keys: list[str],
        seq: str = "seq",
        buckets: int = 64,
        bucket_by: list[str] | None = None,
    ) -> None:
        self.spark, self.root, self.keys, self.seq = spark, root.rstrip("/"), keys, seq
        self.buckets, self.bucket_by = buckets, bucket_by or keys

    def _place(self, rows: DataFrame) -> DataFrame:
        number = F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")
        return rows.withColumn(BUCKET, number)

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/current")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows: numbers below ``buckets``, so a bounded list."""
        return sorted(row[0] for row in self._place(rows).select(BUCKET).distinct().collect())

    def current(self, only: DataFrame | None = None, schema: str | None = None) -> DataFrame:
        """The row of every key.

        ``only`` holds values of key columns, among them those of ``bucket_by``; then only
        their folders are read.  With a ``schema`` a table never written is empty.
        """
        self._finish()
        stored = self._stored()
        if stored is None:
            if schema is None:
                raise ValueError(f"nothing written to {self.root} yet")
            return self.spark.createDataFrame([], schema)
        if only is not None:
            stored = stored.where(F.col(BUCKET).isin(self._touched(only)))
            stored = stored.join(only.distinct(), only.columns, "left_semi")
        return stored.drop(BUCKET)

    def upsert(self, rows: DataFrame, batch_id: int | None = None) -> None:
        """Merge rows; several of one key count as their newest, an equal ``seq`` replaces.

        A batch whose id is that of the last merge was merged already and is left out.
        """
        if self._finish() is not None and batch_id is not None and self._last() == batch_id:
            return
        placed = self._place(rows).withColumn("_new", F.lit(True)).persist()
        try:
            self._merge(placed, batch_id)
        finally:
            placed.unpersist()

    def _merge(self, placed: DataFrame, batch_id: int | None) -> None:
        touched = sorted(row[0] for row in placed.select(BUCKET).distinct().collect())
        if not touched:
            return
        columns = [c for c in placed.columns if c not in (BUCKET, "_new")]
        stored = self._stored()
        if stored is not None:
            if set(stored.columns) != {*columns, BUCKET}:
                raise ValueError(f"columns {columns} are not those stored: {stored.columns}")
            old = stored.where(F.col(BUCKET).isin(touched)).withColumn("_new", F.lit(False))
            placed = placed.unionByName(old)
        rest = [c for c in columns if c not in self.keys]
        newest = F.max_by(F.struct(*rest), F.struct(self.seq, "_new")).alias("_row")
        merged = placed.groupBy(*self.keys, BUCKET).agg(newest)
        (
            merged.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest], BUCKET)
            .withColumn("_batch", F.lit(batch_id).cast("long"))
            .repartition(BUCKET)
            .write.mode("overwrite")
            .parquet(f"{self.root}/pending")
        )
        self._finish()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> int | None:
        row = self.spark.read.parquet(f"{self.root}/pending").select("_batch").first()
        return row[0] if row else None

    def _finish(self) -> bool | None:
        """Put what is pending in its place, unless that is done; None if there was never any."""
        files = self._files()
        if not files.exists(self._path("pending/_SUCCESS")):
            return None
        if not files.exists(self._path("pending/_PLACED")):
            (
                self.spark.read.parquet(f"{self.root}/pending")
                .drop("_batch")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(BUCKET)
                .parquet(f"{self.root}/current")
            )
            files.create(self._path("pending/_PLACED")).close()
        return True


def write_tracking(
    rows: DataFrame,
    root: str,
    keys: list[str],
    batch_id: int,
    seq: str = "seq",
    buckets: int = 64,
) -> None:
    """Save rows by key, the newest replacing older ones."""
    Snapshot(rows.sparkSession, root, keys, seq, buckets).upsert(rows, batch_id)
