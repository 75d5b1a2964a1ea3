"""Log cleaning helpers (P1-P12, P22, J1, J2, J8, Q12, O1, O3, S3) and the end-to-end
cleaning of a trial log (lifecycle: types -> practice -> text -> bad subjects ->
bad lists -> allow-list -> recall order and lags -> recombine in log order).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.nulls import eq_false, nan_to_null, ne_true, strip_lower
from trialspark.operators import ordered, quality
from trialspark.session import broadcast_if_small, stage_table
from trialspark.sources.tables import union_all

LIST_KEYS = ["subject", "session", "list"]

# The one item spelling corrected at ingest.
ITEM_ALIASES = {"axe": "ax"}


def keep_types(df: DataFrame, types: Sequence[str], col: str = "type") -> DataFrame:
    """P1."""
    return df.where(F.col(col).isin(list(types)))


def drop_practice(df: DataFrame, col: str = "list") -> DataFrame:
    """List > 0 (NULL and NaN lists go too, R1)."""
    return df.where(nan_to_null(F.col(col)) > 0)


def normalise_text(df: DataFrame, item: str = "item", category: str | None = "category",
                   fallback: str = "item_name") -> DataFrame:
    """P5: take ``item_name`` when there is no ``item`` column, strip + lower, fix the alias."""
    if item not in df.columns and fallback in df.columns:
        df = df.withColumnRenamed(fallback, item)
    out = df.withColumn(item, strip_lower(item))
    out = out.replace(ITEM_ALIASES, subset=[item])
    if category and category in out.columns:
        out = out.withColumn(category, strip_lower(category))
    return out


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts that give NULL instead of failing on bad input."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the given columns that exist (absent ones are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """P8 (opt-in: makes the schema data-dependent): one aggregate counts non-nulls per column."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in counts.items() if n == 0])


def require_recording(df: DataFrame, file_col: str = "eegfile") -> DataFrame:
    """A recording file is present (not NULL, not empty)."""
    return df.where(F.col(file_col).isNotNull() & (F.col(file_col) != ""))


def exclude_ids(df: DataFrame, excluded: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Rows whose keys are in the exclusion table are removed (anti join)."""
    return df.join(excluded.select(*keys).distinct(), list(keys), "left_anti")


def override_value(df: DataFrame, corrections: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """A correction table (keys, column) overrides the value where it has a row."""
    c = corrections.select(*keys, F.col(column).alias("_fix"))
    return df.join(c, list(keys), "left").withColumn(column, F.coalesce("_fix", column)).drop("_fix")


def closed_loop_filter(index: DataFrame, version: float = 4.0, col: str = "system_version") -> DataFrame:
    """Sessions not recorded on the closed-loop system; a missing version is kept."""
    return index.where(ne_true(col, version))


def keep_allow_list(df: DataFrame, allowed: DataFrame, keys: Sequence[str] = ("subject", "session")
                    ) -> DataFrame:
    """Keep only the frozen (subject, session) population."""
    return df.join(allowed.select(*keys).distinct(), list(keys), "left_semi")


def sessions_used(index: DataFrame, used: DataFrame, index_keys: Sequence[str], used_keys: Sequence[str]
                  ) -> DataFrame:
    """Every used session, with its catalogue row when there is one (right join on keys
    with different names)."""
    cond = [index[a] == used[b] for a, b in zip(index_keys, used_keys)]
    return index.join(used, cond, "right")


def repeated_list_countdowns(events: DataFrame) -> DataFrame:
    """Q12: countdown rows of repeated-list experiments: COUNTDOWN, or WORD at position 0."""
    return events.where((F.col("type") == "COUNTDOWN")
                        | ((F.col("type") == "WORD") & eq_false("serialpos", 0)))


def recode(col: str | Column, mapping: dict, default: Column | None = None) -> Column:
    """Value -> label (unmapped values kept, or ``default``)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(default if default is not None else c) if expr is not None else c


def restore_order(df: DataFrame, order_by: Sequence[str], within_partitions: bool = False) -> DataFrame:
    """O1/O3: sort by the saved order (``sortWithinPartitions`` when writing files)."""
    return df.sortWithinPartitions(*order_by) if within_partitions else df.orderBy(*order_by)


def read_montage_tables(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """S3: contacts / pairs / localization of all montages as one table; the montage keys
    (subject, experiment, montage, localization) are partition columns of the layout
    ``path/kind/subject=.../experiment=.../montage=.../localization=...``."""
    return spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")


# ---------------------------------------------------------------------------
# end-to-end cleaning of a trial log
# ---------------------------------------------------------------------------

def clean_log(log: DataFrame, order_by: Sequence[str], word_type: str, recall_type: str,
              list_length: int | None, gap_min: int, gap_max: int, excluded_subjects: DataFrame | None = None,
              allowed: DataFrame | None = None, min_subjects: int | None = None,
              lagged: Sequence[str] = ("item", "outpos")) -> DataFrame:
    """Clean a log with columns subject, session, list, type, item, mstime (+ order columns).

    Bad subjects (missing presentations or recalls, items that fewer than ``min_subjects``
    subjects saw, plus an exclusion table) are removed before the list checks; lists that repeat
    an item, have the wrong length or a gap out of range are removed, and by the columns of the
    log also lists whose ``recalled`` flags contradict the recalls (Q4), whole lists repeated
    across sessions (``serialpos``, Q7/Q8) and lists whose offsets run backwards (``eegfile``,
    ``eegoffset``, Q9); the allow-list freezes the population; presented items get the output
    position of their first recall and the previous item's values; recall rows get their
    output position and repeat flag; ``lagged`` names the columns taken from the previous item. Returns all rows (presented, recalled, other) with the
    derived columns, NULL where they do not apply.

    Every step that several later ones read - the bad subjects, the log without them, the bad lists, the log without
    those - is a written table, so that no check runs the steps before it again.
    """
    def written(df: DataFrame, what: str) -> DataFrame:
        return stage_table(df, f"clean-{what}-{uuid.uuid4().hex}")
    x = drop_practice(log)
    bad_subjects = quality.subjects_missing_types(x, [word_type, recall_type], ["subject"]).select("subject")
    if min_subjects is not None:
        bad_subjects = bad_subjects.unionByName(
            quality.rare_item_subjects(x.where(F.col("type") == word_type), min_subjects))
    if excluded_subjects is not None:
        bad_subjects = bad_subjects.unionByName(excluded_subjects.select("subject"))
    bad_subjects = written(bad_subjects.distinct(), "subjects")
    small = broadcast_if_small(bad_subjects, 16)
    x = written(exclude_ids(x, bad_subjects) if small is None else x.join(small, ["subject"], "left_anti"), "log")
    words = x.where(F.col("type") == word_type)
    bad = [quality.repeated_presentations(words, order_by),
           quality.timing_issue_lists(words, order_by, gap_min, gap_max)]
    if list_length is not None:
        bad.append(quality.wrong_length_lists(words, list_length))
    if "recalled" in log.columns:
        bad.append(quality.recall_mismatch(words, x.where(F.col("type") == recall_type)))
    if "serialpos" in log.columns:
        bad.extend(quality.duplicated_lists(x, order_by, word_type, recall_type))
    if {"eegfile", "eegoffset"} <= set(log.columns):
        bad.append(quality.offset_backwards_lists(x, order_by, types=[word_type, recall_type]))
    x, _ = quality.remove_bad_lists(x, bad)
    if allowed is not None:
        x = keep_allow_list(x, allowed)
    x = written(x, "kept")
    words = x.where(F.col("type") == word_type)
    rec = x.where(F.col("type") == recall_type)
    # by list first: the window by list and item finds its rows together
    rec = ordered.running_position(rec, LIST_KEYS, order_by, "outpos")
    rec = ordered.mark_later_duplicates(rec, [*LIST_KEYS, "item"], order_by, "recall_repeat")
    first = rec.where(~F.col("recall_repeat")).select(*LIST_KEYS, "item", F.col("outpos").alias("_op"))
    words = words.join(first, [*LIST_KEYS, "item"], "left").withColumnRenamed("_op", "outpos")
    words = words.withColumn("first_recalled", eq_false("outpos", 1))
    words = ordered.lag_columns(words, LIST_KEYS, order_by, lagged)
    other = x.where(~F.col("type").isin(word_type, recall_type))
    return union_all([words, rec, other])
