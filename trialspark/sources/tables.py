"""Scans and sinks.

All inputs are read with an explicit schema or from Parquet; column pruning and
predicate pushdown are left to the Parquet scan, partition pruning to the
partition columns (experiment, period, drop_freq).
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialspark.functions.nulls import clean_nan

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, NaN canonicalised to NULL."""
    return clean_nan(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def read_session_index(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """The session catalogue, optionally one experiment (partition pruning when partitioned)."""
    df = spark.read.parquet(path)
    return df.where(F.col("experiment") == experiment) if experiment else df


def read_events(spark: SparkSession, path: str, experiment: str | None = None,
                subjects: DataFrame | None = None) -> DataFrame:
    """Events of an experiment; ``subjects`` (a one-column DataFrame) restricts by semi join."""
    df = read_session_index(spark, path, experiment)
    if subjects is not None:
        df = df.join(subjects.select("subject").distinct(), "subject", "left_semi")
    return df


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str,
                   null_value: str = "") -> DataFrame:
    """CSV with a header, explicit schema (never inferred), empty string as NULL."""
    return clean_nan(spark.read.csv(path, header=True, schema=schema, nullValue=null_value,
                                    enforceSchema=False))


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = (), fmt: str = "parquet",
                mode: str = "overwrite", cluster_by: Iterable[str] = ()) -> None:
    """Partitioned sink. ``cluster_by`` sorts rows inside each file (subject, session)
    so that readers of one session touch few row groups. Rows are hashed on the partition
    and cluster keys together, so one large (experiment, period) partition is written by many
    tasks - never funnelled through one."""
    partition_by, cluster_by = list(partition_by), list(cluster_by)
    out = df
    if cluster_by:
        out = out.repartition(*(partition_by + cluster_by)).sortWithinPartitions(*(partition_by + cluster_by))
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
        if mode == "overwrite":
            # Only the partitions present in df are replaced (resume / re-run of one slice)
            w = w.option("partitionOverwriteMode", "dynamic")
    w.save(path)


def missing_inputs(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were expected but produced no input (reported, not raised)."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def skip_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose output already exists are not recomputed."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def collect_sessions(spark: SparkSession, path: str, **partition_filter) -> DataFrame:
    """One read of a partitioned result table (schema merged across sessions),
    filtered on partition columns such as experiment, test_period, drop_freq."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    for k, v in partition_filter.items():
        df = df.where(F.col(k).isNull()) if v is None else df.where(F.col(k) == v)
    return df


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name, columns missing on one side become NULL."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------------
# S11 period parameters.
# Epoch windows, event types and time reductions per analysis
# period, with the experiment-specific overrides. Times are seconds relative
# to the event onset; keep_ms is an inclusive window kept after the buffer is
# removed; bin_s is the width of time bins (None = mean over time).
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class PeriodParams:
    period: str
    event_types: tuple[str, ...]
    start_s: float
    end_s: float
    buffer_s: float = 1.0
    keep_ms: tuple[int, int] | None = None
    bin_s: float | None = None


@dataclass(frozen=True)
class ExperimentParams:
    list_length: int
    gap_min_ms: int
    gap_max_ms: int
    rare_item_min_subjects: int = 6
    periods: dict = field(default_factory=dict)


_DEFAULT_PERIODS = {
    "encoding": PeriodParams("encoding", ("WORD",), -0.5, 2.1, 1.0, keep_ms=(15, 1575)),
    "encoding_end": PeriodParams("encoding_end", ("WORD",), 1.1, 1.6, 1.0),
    "encoding_isi": PeriodParams("encoding_isi", ("WORD",), -0.7, 0.0, 1.0),
    "distractor": PeriodParams("distractor", ("DISTRACT_END",), -20.0, 0.0, 1.0, bin_s=1.0),
    "countdown": PeriodParams("countdown", ("COUNTDOWN_START",), 0.0, 10.0, 1.0, bin_s=1.0),
}
_REPEATED_LIST_PERIODS = {
    "countdown": PeriodParams("countdown", ("COUNTDOWN",), 0.0, 3.8, 1.0, bin_s=1.0),
    "distractor": PeriodParams("distractor", ("REC_START",), -7.0, 0.0, 1.0, bin_s=1.0),
    "encoding": PeriodParams("encoding", ("WORD",), -0.5, 2.1, 1.0, keep_ms=(0, 750)),
}

# 8 wavelet frequencies, log-spaced from 3 to 180 Hz, and their rounded labels.
FREQ_MIN_HZ, FREQ_MAX_HZ, N_FREQS = 3.0, 180.0, 8
DROPPED_FREQ_HZ_LABELS = (3, 5.4, 9.7, 17.3, 31.1, 55.9, 100.3, 180)
LINE_NOISE_HZ = (58.0, 62.0)
RESAMPLE_HZ = 1000
WAVELET_WIDTH = 5
PAIR_DISTANCE_MM = 25.0
MIN_PAIRS_PER_MONTAGE = 10


def experiment_params(experiment: str) -> ExperimentParams:
    """Parameters by experiment name (repeated-list experiments differ)."""
    periods = dict(_DEFAULT_PERIODS)
    if "RepFR" in experiment:
        periods.update(_REPEATED_LIST_PERIODS)
        return ExperimentParams(27, 1300, 2800, periods=periods)
    return ExperimentParams(12, 2350, 2800, periods=periods)


def period_params(experiment: str, period: str) -> PeriodParams:
    return experiment_params(experiment).periods[period]


def period_table(spark: SparkSession, experiment: str, unit_ms: int = 1000, types: dict[str, str] | None = None) -> DataFrame:
    """One row per period and event type, its windows in ms with ``unit_ms`` to the second (another unit
    for logs on another time scale), event types renamed by ``types``. A handful of fixed rows, broadcast when joined."""
    def ms(v: float | None, per: float = 1.0) -> int | None:
        return None if v is None else round(v * unit_ms / per)
    rows = [(p.period, (types or {}).get(t, t), ms(p.start_s), ms(p.end_s), ms(p.buffer_s),
             *(ms(v, 1000.0) for v in p.keep_ms or (None, None)), ms(p.bin_s))
            for p in experiment_params(experiment).periods.values() for t in p.event_types]
    schema = ("period string, type string, start_ms long, end_ms long, buffer_ms long, keep_lo_ms long, "
              "keep_hi_ms long, bin_ms long")
    return F.broadcast(spark.createDataFrame(rows, schema))


def longest_epoch_ms(experiment: str, unit_ms: int = 1000) -> int:
    """Length of the longest epoch of the experiment's periods, buffers included."""
    return max(round((p.end_s - p.start_s + 2 * p.buffer_s) * unit_ms) for p in experiment_params(experiment).periods.values())


# ---------------------------------------------------------------------------
# S8 power tables: partitioned by experiment and period, rows clustered by session
# ---------------------------------------------------------------------------

def write_power(df: DataFrame, path: str, partition_by: Iterable[str] = ("experiment", "period"),
                cluster_by: Iterable[str] = ("subject", "session")) -> None:
    """Persist a power table (array form: one row per event with its feature array, or long
    form: one row per event x channel x frequency [x time bin]). Only the partitions present
    in ``df`` are replaced, so one period of one experiment can be rewritten on its own."""
    write_table(df, path, partition_by=partition_by, cluster_by=cluster_by)


def read_power(spark: SparkSession, path: str, experiment: str | None = None, period: str | None = None
               ) -> DataFrame:
    """Read a power table; experiment/period filters prune partitions."""
    df = spark.read.parquet(path)
    if experiment is not None:
        df = df.where(F.col("experiment") == experiment)
    if period is not None:
        df = df.where(F.col("period") == period)
    return df


def power_to_long(df: DataFrame, features: str = "features", n_freqs: int = 8) -> DataFrame:
    """Array form -> long form (channel, frequency index, power); generated in-stage."""
    out = df.select(*[c for c in df.columns if c != features], F.posexplode(features).alias("_k", "power"))
    return out.withColumns({"channel": F.floor(F.col("_k") / n_freqs), "frequency_index": F.col("_k") % n_freqs}
                           ).drop("_k")
