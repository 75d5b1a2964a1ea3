"""Trial-log quality checks.

Every check returns its offenders as a table of (subject, session, list) keys
(or subjects), so the union of all offenders can be removed by one anti join
(Q10). Column names follow the library's log schema: subject, session, list,
type, item, serialpos, recalled, mstime; ``order_by`` is the log's total order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.nulls import cond_false, ne_true
from trialspark.operators import ordered
from trialspark.sources.tables import union_all

LIST_KEYS = ["subject", "session", "list"]


def subjects_missing_types(log: DataFrame, types: Sequence[str], keys: Sequence[str] = ("subject",),
                           type_col: str = "type") -> DataFrame:
    """Q1/A2: units whose set of distinct types among ``types`` is incomplete."""
    keys = list(keys)
    return (log.where(F.col(type_col).isin(list(types)))
               .groupBy(*keys).agg(F.countDistinct(type_col).alias("n_types"))
               .where(F.col("n_types") != len(types)))


def rare_item_subjects(words: DataFrame, min_subjects: int, item: str = "item",
                       subject: str = "subject") -> DataFrame:
    """Q2/A3: subjects who saw an item that fewer than ``min_subjects`` subjects saw."""
    per_item = words.groupBy(item).agg(F.countDistinct(subject).alias("n_subjects"))
    rare = per_item.where(F.col("n_subjects") < min_subjects).select(item)
    return words.join(rare, item, "left_semi").select(subject).distinct()


def repeated_presentations(words: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Lists in which an item is presented more than once."""
    rep = ordered.occurrence_number(words, LIST_KEYS, order_by, "item", "rep_num")
    return rep.where(F.col("rep_num") > 1).select(*LIST_KEYS).distinct()


def recall_mismatch(words: DataFrame, recalls: DataFrame) -> DataFrame:
    """Lists where the recalled flag contradicts the recall rows.

    The right side is de-duplicated on the join keys, so a repeated recall can
    not multiply word rows; the match indicator is ``matched IS NOT NULL``.
    """
    keys = [*LIST_KEYS, "item"]
    rec = recalls.select(*keys).distinct().withColumn("_matched", F.lit(True))
    j = words.join(rec, keys, "left")
    matched = F.col("_matched").isNotNull()
    bad = ((F.col("recalled") == 1) & ~matched) | ((F.col("recalled") == 0) & matched)
    return j.where(cond_false(bad)).select(*LIST_KEYS).distinct()


def wrong_length_lists(words: DataFrame, expected: int) -> DataFrame:
    """Q5/A4/A5: lists whose number of presented items differs from ``expected``."""
    return (words.groupBy(*LIST_KEYS).agg(F.count(F.lit(1)).alias("n_items"))
                 .where(F.col("n_items") != expected))


def timing_issue_lists(words: DataFrame, order_by: Sequence[str], gap_min: int, gap_max: int,
                       time_col: str = "mstime") -> DataFrame:
    """Lists with a gap between consecutive items outside [gap_min, gap_max]."""
    d = ordered.diff(words, LIST_KEYS, order_by, time_col, "_gap")
    return d.where((F.col("_gap") > gap_max) | (F.col("_gap") < gap_min)).select(*LIST_KEYS).distinct()


def duplicated_lists(log: DataFrame, order_by: Sequence[str], word_type: str, recall_type: str,
                     dup_keys: Sequence[str] = ("subject", "list", "serialpos", "item", "type")
                     ) -> tuple[DataFrame, DataFrame]:
    """Q7 and Q8: whole lists repeated across sessions.

    Q7 (keep=False): the presented list is fully duplicated but its recalls are not
    -> both copies are bad. Q8 (keep first): presented list and recalls are fully
    duplicated -> the later copy is bad.
    """
    wr = log.where(F.col("type").isin(word_type, recall_type))
    flagged = ordered.duplicate_flags(wr, list(dup_keys), order_by, "_all", "_later")
    # The whole (list, type) is duplicated when sum(flag) equals count(item)
    per_type = flagged.groupBy(*LIST_KEYS, "type").agg(
        F.count("item").alias("_n"), *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("_all", "_later")])

    def full(flag: str) -> DataFrame:
        # Distinct types among the fully duplicated (list, type) rows of each list
        return per_type.where(F.col(flag) == F.col("_n")).groupBy(*LIST_KEYS).agg(
            F.count_distinct("type").alias("n_types"), F.max(F.col("type") == word_type).alias("_words"))

    q7 = full("_all").where(F.col("_words") & (F.col("n_types") == 1))
    q8 = full("_later").where(F.col("_words") & (F.col("n_types") == 2))
    return q7.select(*LIST_KEYS), q8.select(*LIST_KEYS)


def offset_backwards_lists(log: DataFrame, order_by: Sequence[str], file_col: str = "eegfile",
                           offset_col: str = "eegoffset", types: Sequence[str] | None = None) -> DataFrame:
    """Lists containing a row whose file offset is smaller than the previous row's
    offset within the same recording file (rows without a file or with offset -1 skipped, R4)."""
    ev = log
    if types:
        ev = ev.where(F.col("type").isin(list(types)))
    ev = ev.where(ne_true(file_col, "") & F.col(file_col).isNotNull() & ne_true(offset_col, -1))
    d = ordered.diff(ev, [file_col], order_by, offset_col, "_odiff")
    return d.where(F.col("_odiff") < 0).select(*LIST_KEYS).distinct()


def flag_bad_lists(words: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                   expected_len: int | None = None, gap: tuple[int, int] | None = None,
                   recall_flag: str | None = None, time_col: str = "mstime") -> DataFrame:
    """Q3-Q6 as window flags over each list (adds ``bad_list``).

    For logs where every check is local to a list - repeated item (Q3), recalled flag vs
    recall marker on the item's rows (Q4, ``recall_flag`` names the marker column), list
    length (Q5), gap between consecutive items (Q6) - each check is a window over the list
    and the list is bad if any row fails. No offender tables, no union, no anti join: when
    the rows are already partitioned by list, nothing is shuffled again.
    """
    keys = list(keys)
    w_list = Window.partitionBy(*keys)
    w_item = Window.partitionBy(*keys, "item")
    rowbad = F.lit(False)
    x = words
    x = x.withColumn("_rep", F.when(F.col("item").isNotNull(),
                                    F.row_number().over(w_item.orderBy(*order_by)) > 1))
    rowbad = rowbad | F.coalesce(F.col("_rep"), F.lit(False))
    if recall_flag is not None:
        matched = F.max(F.col(recall_flag).cast("int")).over(w_item) == 1
        mism = ((F.col("recalled") == 1) & ~matched) | ((F.col("recalled") == 0) & matched)
        rowbad = rowbad | cond_false(mism)
    if gap is not None:
        g = F.col(time_col) - F.lag(time_col).over(w_list.orderBy(*order_by))
        rowbad = rowbad | cond_false((g > gap[1]) | (g < gap[0]))
    x = x.withColumn("_rowbad", rowbad)
    listbad = F.max("_rowbad").over(w_list)
    if expected_len is not None:
        listbad = listbad | (F.count(F.lit(1)).over(w_list) != expected_len)
    return x.withColumn("bad_list", listbad).drop("_rep", "_rowbad")


def remove_bad_lists(log: DataFrame, bad: Iterable[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Q10: union of all offender tables (distinct) and the log without them (anti join)."""
    bad_union = union_all([b.select(*LIST_KEYS) for b in bad]).distinct()
    return log.join(bad_union, LIST_KEYS, "left_anti"), bad_union


def countdown_list_repair(cd: DataFrame, order_by: Sequence[str], file_col: str | None = "eegfile"
                          ) -> DataFrame:
    """Q11: repair countdown rows logged one list late.

    Occurrence of each type inside a list (W3); lists with >= 3 occurrences, a
    missing recording file, or repeats past list 1 are bad (W4); sessions whose
    list 1 holds a second START/END pair are shifted: the second pair of list 1
    and every later list move up by one (J5, P25). Bad rows are removed.
    """
    x = ordered.running_position(cd, [*LIST_KEYS, "type"], order_by, "type_occurrence", zero_based=True)
    x = ordered.group_max(x, LIST_KEYS, "type_occurrence", "max_type_occurrence")
    no_file = (F.col(file_col).isNull() | (F.col(file_col) == "")) if file_col else F.lit(False)
    bad = ((F.col("max_type_occurrence") >= 2) | no_file
           | ((F.col("max_type_occurrence") != 0) & (F.col("list") > 1)))
    x = x.withColumn("bad_list", cond_false(bad))
    x = ordered.group_max(x, LIST_KEYS, "bad_list", "any_bad_list")
    second_in_first = (F.col("type_occurrence") == 1) & (F.col("list") == 1)
    # Sessions to fix (a second START/END in list 1), as a distinct-session table joined
    # back - a session-wide window would sort a whole (possibly huge) session in one task
    fix = x.where(second_in_first).select("subject", "session").distinct().withColumn(
        "session_to_fix", F.lit(True))
    x = x.join(fix, ["subject", "session"], "left").withColumn(
        "session_to_fix", F.coalesce("session_to_fix", F.lit(False)))
    shift = (second_in_first & ~F.col("any_bad_list")) | (F.col("session_to_fix") & (F.col("list") != 1))
    x = x.withColumn("new_list", F.when(shift, F.col("list") + 1).otherwise(F.col("list")))
    return x.where(~F.col("bad_list"))


def countdown_gaps(cd: DataFrame, order_by: Sequence[str], time_col: str = "mstime") -> DataFrame:
    """Q13 first half: gap to the previous countdown row of the list; the first row of
    each list takes the next row's gap (back-fill)."""
    d = ordered.diff(cd, LIST_KEYS, order_by, time_col, "diff")
    return ordered.backward_fill(d, LIST_KEYS, order_by, "diff")


def gap_stats(gaps: DataFrame, keys: Sequence[str] = ("subject", "session"), col: str = "diff"
              ) -> DataFrame:
    """Mean and sample sd of gaps per unit, also in seconds."""
    return gaps.groupBy(*keys).agg(F.avg(col).alias("diff_mean"), F.stddev_samp(col).alias("diff_std")) \
        .withColumns({"diff_mean_s": F.col("diff_mean") / 1000, "diff_std_s": F.col("diff_std") / 1000})


def top_by(df: DataFrame, col: str, k: int, tie_break: Sequence[str]) -> DataFrame:
    """O2: the k largest values (a report; the limit is the feature)."""
    return df.orderBy(F.col(col).desc_nulls_last(), *tie_break).limit(k)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations occurring more than once (should be empty). Rows with NULL keys
    are checked too (unlike the reference, which skipped them)."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def step_counts(steps: Sequence[tuple[str, DataFrame]], subject: str = "subject",
                session: str = "session") -> DataFrame:
    """Rows, unique subjects and unique (subject, session) after each pipeline step,
    as one unioned table (one aggregate per step, run as a single job)."""
    frames = []
    for i, (name, df) in enumerate(steps):
        frames.append(df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct(subject).alias("n_subjects"),
            F.countDistinct(subject, session).alias("n_sessions"),
        ).select(F.lit(i).cast("bigint").alias("step"), F.lit(name).alias("step_name"), "*"))
    return union_all(frames)


def flag_step_counts(df: DataFrame, steps: Sequence[tuple[str, Column]], subject: str = "subject", session: str = "session") -> DataFrame:
    """A19 where every step is a condition on the rows of one table: all counts from one pass. Rows are counted per
    (subject, session) and these per subject, so no distinct count expands the rows."""
    named = [f"_k{i}" for i in range(len(steps))]
    per = df.groupBy(subject, session).agg(*[F.count(F.when(c, 1)).alias(k) for k, (_, c) in zip(named, steps)])
    per = per.groupBy(subject).agg(*[F.sum(k).alias(k) for k in named], *[F.count(F.when(F.col(k) > 0, 1)).alias(f"{k}_s") for k in named])
    out = per.agg(*[F.struct(F.lit(i).cast("bigint").alias("step"), F.lit(name).alias("step_name"), F.coalesce(F.sum(k), F.lit(0)).alias("n_rows"),
                             F.count(F.when(F.col(k) > 0, 1)).alias("n_subjects"), F.coalesce(F.sum(f"{k}_s"), F.lit(0)).alias("n_sessions")).alias(k)
                    for i, (k, (name, _)) in enumerate(zip(named, steps))])
    return out.select(F.explode(F.array(*named)).alias("r")).select("r.*")
