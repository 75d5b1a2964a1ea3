import pyarrow as pa
from pyspark.sql import functions as F

from trialspark.llm import staging


def test_a_worker_gets_a_few_megabytes_at_once(spark):
    """Spark's default let a batch hold 10,000 rows of any texts up to 64 MB, here all 12 MB of the partition."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    held = spark.conf.get(staging.BATCH_CONF)
    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))
    try:
        spark.conf.unset(staging.BATCH_CONF)
        got = staging.arrow_map(texts, sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 6000
        assert max(r.size for r in got) <= staging.BATCH_BYTES * 1.1
        spark.conf.set(staging.BATCH_CONF, "1m")  # a smaller value of the session's own holds
        got = staging.arrow_map(texts, sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 6000 and max(r.size for r in got) <= 1.1 * (1 << 20)
    finally:
        spark.conf.set(staging.BATCH_CONF, held)
