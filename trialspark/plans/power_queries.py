"""Epochs of all periods by sensor pair.

Recording role of the event log: ten users make a session, the event types are its contacts, and a contact's samples
are the mean values on a grid of SAMPLE_MS; neighbouring contacts by name form the sensor pairs. One second of the
experiment's windows is UNIT_MS of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.nulls import r6
from trialspark.operators import epochs
from trialspark.plans import power_oracle as oracle
from trialspark.plans.registry import register
from trialspark.session import file_bytes, initial_shuffle_partitions
from trialspark.sources import roles
from trialspark.sources.tables import longest_epoch_ms, period_table

USERS_PER_SESSION = 10
SAMPLE_MS, UNIT_MS = 10_800_000, 43_200_000
CONTACTS = ["click", "error", "purchase", "signup", "view"]
ONSET_TYPES = {"WORD": "view", "DISTRACT_END": "error", "COUNTDOWN_START": "signup"}
EPOCH = ["onset_id", "period"]
#: bytes of the event files whose epochs one task cuts (an event gives some 140 rows)
EVENT_BYTES = 1 << 18


def recording(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(onsets, samples, sensor pairs) of the recording role."""
    ev = roles.event_log(spark, sf_dir).withColumn("session", F.expr(f"subject div {USERS_PER_SESSION}"))
    onsets = ev.select(F.col("event_id").alias("onset_id"), "session", "type", "mstime")
    grid = (F.floor(F.col("mstime") / SAMPLE_MS) * SAMPLE_MS).cast("bigint")
    samples = ev.groupBy("session", F.col("type").alias("contact"), grid.alias("mstime")).agg(F.avg("value").alias("value"))
    pairs = spark.createDataFrame(list(zip(CONTACTS[:-1], CONTACTS[1:])), "contact_1 string, contact_2 string")
    return onsets, samples, pairs


@register("period_bins", "J13,J15,T1,T2,T6,T7,S11,A13", oracle.PERIOD_BINS)
def period_bins(spark, sf_dir):
    onsets, samples, pairs = recording(spark, sf_dir)
    # pairs are formed of the samples, before every onset's epoch repeats them
    samples = epochs.pair_difference(samples, pairs, ["session"], at="mstime")
    parts = initial_shuffle_partitions(file_bytes(spark, f"{sf_dir}/events.parquet"), EVENT_BYTES, 2)
    ep = epochs.epochs_by_period(onsets, samples, period_table(spark, "catFR1", UNIT_MS, ONSET_TYPES), ["session"],
                                 longest_epoch_ms("catFR1", UNIT_MS), parts=parts)
    # session and bucket are an onset's own; with them, mean and bins are formed where the join left the epoch
    channel = ["session", "bucket", *EPOCH, "contact_1", "contact_2"]
    ep = ep.withColumn("value", F.col("value") - epochs.epoch_mean("value", channel))
    out = epochs.reduce_periods(ep, "value", channel)
    return out.select(*EPOCH, "contact_1", "contact_2", "time_bin", r6("value", 9).alias("value"), "n")
