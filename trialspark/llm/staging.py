"""Shared tables that cut lineage, and joins against tables of a checked size."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when it has been written, counted and found at most this large.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
#: bytes in memory for a written byte, at most
UNPACKED = 8
#: bytes of rows that a Python worker gets at once. Spark's own 64 MB let one batch hold a whole partition of texts,
#: twice in the executor's native memory (vectors and socket buffer, both grown by doubling) and once in the worker
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per application (as
    ``--py-files`` would), so that functions run in workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="llm-ship-"), "trialspark_sources.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(d, n)
                    z.write(f, os.path.relpath(f, os.path.dirname(package)))
    sc.addPyFile(out)
    sc._llm_shipped = True


def tidy() -> None:
    """Give memory that is free back to the system: a worker is used again by later stages, next to an executor
    whose limit counts what the worker keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _tidied(function):
    def run(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                tidy()
        yield from function(each())
        tidy()
    return run


def short_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to ``BATCH_BYTES``. Spark reads the setting when a plan runs, so it stays; a
    smaller value of the session's own holds."""
    to_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if to_bytes(spark.conf.get(BATCH_CONF)) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, which get batches of bounded bytes and keep no
    free memory."""
    ship(df.sparkSession)
    short_batches(df.sparkSession)
    return df.mapInArrow(_tidied(function), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where the session names none
    (local tests only), a temporary folder is set; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-ckpt-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the plan above it
    starts from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written_bytes(staged: DataFrame) -> int:
    """Bytes of the files of a staged table."""
    spark = staged.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged._staged_path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def small_or_plain(staged: DataFrame, row_bytes: int) -> DataFrame:
    """``staged`` with a broadcast hint if its counted rows, at ``row_bytes`` each, and its written bytes, unpacked,
    both stay under the bound; otherwise as it is, so that the join shuffles. The bytes hold for rows with arrays,
    which have no fixed size. A frame derived from a staged table is held to its rows alone."""
    n = staged.count()
    unpacked = written_bytes(staged) * UNPACKED if hasattr(staged, "_staged_path") else 0
    return F.broadcast(staged) if n <= BROADCAST_ROWS and max(n * row_bytes, unpacked) <= BROADCAST_BYTES else staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
