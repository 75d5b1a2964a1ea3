"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. ANSI stays on (Spark default); ratios go through
# try_divide so that a zero denominator gives NULL rather than an error.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # group sizes for the grouped pandas bodies are bounded by design (one
    # session x channel), so a moderate Arrow batch keeps worker memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    # partition sizing: scans split at 256 MB, shuffle partitions coalesced by AQE towards
    # 128 MB, and a shuffle partition counts as skewed above 256 MB (and 5x the median),
    # so one hot key is split before it exhausts an executor.
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
}


def initial_shuffle_partitions(input_bytes: int, target_bytes: int = 128 << 20, minimum: int = 8) -> int:
    """Initial shuffle partition count for a job reading ``input_bytes``: enough partitions
    that each holds about ``target_bytes`` before AQE coalesces the small ones (at 100 TB and
    128 MB this is ~800k; set it as ``spark.sql.shuffle.partitions`` or
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum``)."""
    return max(minimum, -(-int(input_bytes) // int(target_bytes)))


def deal(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` hash-partitioned by ``key`` into ``parts``, a count that adaptive execution leaves as it is."""
    return df.repartition(parts, key)


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a written table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "trialspark") -> SparkSession:
    """Return the active session, creating a local one with the base settings if none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A value is only set here when the session has none (local tests); on a cluster
    the configured shared folder is always used.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if default is None:
            raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
        d = default
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def _delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: a written table is broadcast only if it has been counted and found at most this large
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def broadcast_if_small(written: DataFrame, row_bytes: int) -> DataFrame | None:
    """``written`` with a broadcast hint if its counted rows, at ``row_bytes`` each, stay under the bound, else None."""
    n = written.count()
    return F.broadcast(written) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else None


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """Write ``df`` once under the shared checkpoint folder, yield it read back, and remove
    it afterwards - for multi-pass steps (model fits) whose results do not reference it."""
    spark = df.sparkSession
    name = f"staged-{uuid.uuid4().hex}"
    out = stage_table(df, name)
    try:
        yield out
    finally:
        _delete_path(spark, os.path.join(checkpoint_dir(spark), "tables", name))


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Persist an intermediate table as Parquet under the shared checkpoint folder and read it back.

    Used between pipeline stages that the reference kept as files, so that a lost
    executor only recomputes from the last written table.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    path = os.path.join(base, "tables", name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)
