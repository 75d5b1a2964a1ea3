"""Epoching around events.

J13 is a range join: every sample whose time lies in [onset + start - buffer,
onset + end + buffer] joins its onset. Spark has no range-join strategy, and a
theta join would be a nested loop, so the time axis is cut into buckets whose
width is the full epoch length: each onset is exploded to the (at most two)
buckets its window touches, samples carry their single bucket, and the join
is an equi-join on (subject, bucket) plus the exact range predicate. The
sample side is never replicated; a hot subject is spread over its time
buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epochs(onsets: DataFrame, samples: DataFrame, keys: list[str], onset_time: str, sample_time: str,
           start_ms: int, end_ms: int, buffer_ms: int) -> DataFrame:
    """(onset, sample) rows with ``rel`` = sample time - onset time, for samples inside
    the buffered window (both ends inclusive). ``onsets`` must carry an ``onset_id``."""
    lo_off, hi_off = start_ms - buffer_ms, end_ms + buffer_ms
    width = hi_off - lo_off
    o = onsets.select("onset_id", *[F.col(k).alias(f"_o_{k}") for k in keys],
                      F.col(onset_time).alias("_t0"))
    o = o.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("_t0") + lo_off) / width),
                                                     F.floor((F.col("_t0") + hi_off) / width))))
    extra = [c for c in samples.columns if c not in keys and c != sample_time]
    s = samples.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col(sample_time).alias("_ts"),
                       *[F.col(c).alias(f"_s_{c}") for c in extra])
    s = s.withColumn("_sbucket", F.floor(F.col("_ts") / width))
    cond = [F.col(f"_o_{k}") == F.col(f"_s_{k}") for k in keys] + [
        F.col("_bucket") == F.col("_sbucket"),
        F.col("_ts").between(F.col("_t0") + lo_off, F.col("_t0") + hi_off)]
    j = o.join(s, cond, "inner")
    return j.select("onset_id", *[F.col(f"_o_{k}").alias(k) for k in keys],
                    (F.col("_ts") - F.col("_t0")).alias("rel"), *[F.col(f"_s_{c}").alias(c) for c in extra])


def demean(ep: DataFrame, value: str, by: str = "onset_id", out: str | None = None) -> DataFrame:
    """Subtract the epoch's mean over time (buffer included, as the reference does)."""
    return ep.withColumn(out or value, F.col(value) - F.avg(value).over(Window.partitionBy(by)))


def epoch_mean(value: str, keys: list[str]) -> Column:
    """The mean of a channel's epoch over time, buffer included, on every row of the epoch."""
    return F.avg(value).over(Window.partitionBy(*keys))


def trim_buffer(ep: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Keep the inclusive window [start, end]."""
    return ep.where(F.col("rel").between(start_ms, end_ms))


def time_bins(ep: DataFrame, start_ms: int, end_ms: int, width_ms: int, name: str = "time_bin") -> DataFrame:
    """T7 (R15): right-closed bins (a, a + width], the first edge excluded, labelled by the
    left edge; edges run from start in steps of width up to the last edge >= end, so a
    partial last bin is kept (3.8 s -> 4 bins)."""
    n_bins = -(-(end_ms - start_ms) // width_ms)
    stop_edge = start_ms + n_bins * width_ms
    idx = F.ceil((F.col("rel") - F.lit(start_ms)) / F.lit(width_ms)) - 1
    return ep.where((F.col("rel") > start_ms) & (F.col("rel") <= stop_edge)).withColumn(
        name, (F.lit(start_ms) + idx * F.lit(width_ms)).cast("bigint"))


def binned_mean(ep: DataFrame, value: str, keys: list[str], time_col: str = "time_bin") -> DataFrame:
    """Mean per (epoch, bin)."""
    return ep.groupBy(*keys, time_col).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# all periods in one job, and sensor pairs (T1 with channels, T6, T7, S11, J15)
# ---------------------------------------------------------------------------

def epochs_by_period(onsets: DataFrame, samples: DataFrame, periods: DataFrame, keys: list[str], longest_ms: int,
                     onset_time: str = "mstime", sample_time: str = "mstime", parts: int | None = None) -> DataFrame:
    """J13 with windows from a parameter table: (onset, period, sample) rows with ``rel`` and the period's columns.

    ``onsets`` (onset_id, type, keys, time) meet their periods by event type, so every row has a window of its own;
    buckets are as wide as the longest epoch, so a window touches at most two of them. An onset goes to the first of
    its two (``bucket``), a sample to its own and the one before, so an equi-join on keys and bucket brings a whole
    epoch together; steps that group by keys, ``bucket`` and more then move no row again. ``parts`` sets the number
    of tasks, which a join of small sides into many rows would else leave too low.
    """
    o = onsets.join(F.broadcast(periods), "type").withColumn("_t0", F.col(onset_time)).drop(onset_time, "type")
    lo, hi = F.col("_t0") + F.col("start_ms") - F.col("buffer_ms"), F.col("_t0") + F.col("end_ms") + F.col("buffer_ms")
    o = o.withColumns({"_lo": lo, "_hi": hi}).withColumn("bucket", F.floor(F.col("_lo") / longest_ms))
    own = F.floor(F.col(sample_time) / longest_ms)
    s = samples.withColumn("bucket", F.explode(F.array(own - 1, own))).withColumnRenamed(sample_time, "_ts")
    if parts:
        o, s = o.repartition(parts, *keys, "bucket"), s.repartition(parts, *keys, "bucket")
    j = o.join(s, [*keys, "bucket"]).where(F.col("_ts").between(F.col("_lo"), F.col("_hi")))
    return j.withColumn("rel", F.col("_ts") - F.col("_t0")).drop("_lo", "_hi", "_t0", "_ts")


def pair_difference(ep: DataFrame, pairs: DataFrame, epoch: list[str], contact: str = "contact", value: str = "value",
                    at: str = "rel") -> DataFrame:
    """T1 with channels: value of ``contact_1`` minus value of ``contact_2`` at the sample times of an epoch (or, with
    ``at`` the time, of a whole recording before it is cut) that both have. Every epoch sample goes once, signed, to each pair that its contact belongs to, and a pair's two samples
    meet in one aggregation; the epochs are not joined with themselves and not cut again for each pair."""
    ends = pairs.select("contact_1", "contact_2", F.explode(F.array(
        F.struct(F.col("contact_1").alias(contact), F.lit(1).alias("_sign")),
        F.struct(F.col("contact_2").alias(contact), F.lit(-1).alias("_sign")))).alias("_e")).select("contact_1", "contact_2", "_e.*")
    signed = ep.join(F.broadcast(ends), contact).where(F.col(value).isNotNull())
    return (signed.groupBy(*epoch, "contact_1", "contact_2", at)
            .agg(F.sum(F.col("_sign") * F.col(value)).alias(value), F.sum(F.abs("_sign")).alias("_n"), F.sum("_sign").alias("_both"))
            .where("_n = 2 and _both = 0").drop("_n", "_both"))


def reduce_periods(ep: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """T6 + T7 by each row's own period: without the buffer, the mean over the kept window, or over right-closed bins
    labelled by their left edge (``time_bin``, NULL for a period without bins)."""
    rel, start, end, width = F.col("rel"), F.col("start_ms"), F.col("end_ms"), F.col("bin_ms")
    plain = rel.between(F.greatest(F.coalesce("keep_lo_ms", start), start), F.least(F.coalesce("keep_hi_ms", end), end))
    kept = F.when(width.isNull(), plain).otherwise((rel > start) & (rel <= end))
    label = start + (F.ceil((rel - start) / width) - 1) * width
    return (ep.where(kept).withColumn("time_bin", F.when(width.isNotNull(), label).cast("bigint"))
            .groupBy(*keys, "time_bin").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")))
