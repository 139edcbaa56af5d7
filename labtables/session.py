"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that only matter for speed or for reproducible timestamps; every
# operator is also correct on a plain session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when the aggregate above it then needs one more
    # (already reduced) shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Small post-shuffle partitions join by hash instead of sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.ui.enabled": "false",
}


# Only for clusters: many small shuffle partitions to begin with, joined up by
# adaptive execution to the advisory size, so that the same code suits small and
# very large shuffles.
CLUSTER = {
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app: str, master: str | None = None, **overrides: str) -> SparkSession:
    """A session with the defaults above; pass ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS if master else {**DEFAULTS, **CLUSTER}
    for key, value in {**settings, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, empty folder for one run.

    On a cluster it lies in the shared folder named by ``spark.checkpoint.dir``,
    so that any executor can read what another one wrote.  Only where that
    setting is absent and everything runs in one process (tests, one machine) a
    local temporary folder is used; on a cluster its absence is an error, as
    executors would write where the others cannot read.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/labtables/{label}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix='labtables-')}/{label}"
