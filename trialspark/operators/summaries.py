"""Descriptive within-subject statistics (W12, W13, A15, A16, ST13).

The reference adds nested group means to every row (list, then session mean of
the row-repeated list means, then subject, then overall), adjusts each value by
``value - list_mean + overall_mean`` (Cousineau), averages the adjusted value up
the hierarchy list -> session -> subject per condition, and reports mean and
SE = sd / sqrt(n) over subjects.

Spark plan: the adjusted mean of a (list, condition) cell is
``mean(value | cell) - list_mean + overall_mean``, so the raw rows are touched by
exactly one partial aggregation to (list, condition) sums and counts. The list
mean comes from those few cell rows (a window over <= #conditions rows per list)
and the overall mean is a scalar subquery; every later level aggregates the
already reduced table. No row-level window over a large group and no cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add_nested_means(df: DataFrame, value: str, levels: Sequence[str], prefix: str | None = None,
                     weighting: str = "rows") -> DataFrame:
    """W12 + W13 on the row level (for users who want the per-row columns).

    ``levels`` is the nesting from outer to inner, e.g. [subject, session, list]. With
    ``weighting='rows'`` (reference behaviour) each level averages the row-repeated means of
    the level below, which equals the plain mean of the level's values; ``'unit'`` gives
    each lower unit equal weight instead. Each level is an aggregate joined back on its keys
    (partial aggregation before the shuffle; AQE splits a hot key on the row side) rather
    than a window that would sort a whole subject in one task.
    """
    prefix = prefix or value
    levels = list(levels)
    names = ["list", "sess", "sub"]
    out = df
    unit_means = df.groupBy(*levels).agg(F.avg(value).alias("_u"), F.count(value).alias("_n"))
    for depth, name in zip(range(len(levels), 0, -1), names):
        keys = levels[:depth]
        if depth == len(levels):
            m = unit_means.select(*keys, F.col("_u").alias(f"{prefix}_{name}_mean"))
        elif weighting == "rows":
            m = unit_means.groupBy(*keys).agg(
                F.try_divide(F.sum(F.col("_u") * F.col("_n")), F.sum("_n")).alias(f"{prefix}_{name}_mean"))
        else:
            m = unit_means.groupBy(*keys).agg(F.avg("_u").alias(f"{prefix}_{name}_mean"))
            unit_means = m.select(*keys, F.col(f"{prefix}_{name}_mean").alias("_u"), F.lit(1).alias("_n"))
        m = m.select(*[F.col(k).alias(f"_m_{k}") for k in keys], f"{prefix}_{name}_mean")
        out = out.join(m, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys], "left").drop(
            *[f"_m_{k}" for k in keys])
    if weighting == "rows":
        overall = df.select(F.avg(value)).scalar()
    else:  # equal weight up to the top: the mean of the outermost units' means
        overall = unit_means.select(F.avg("_u")).scalar()
    return out.withColumns({
        f"{prefix}_all_mean": overall,
        f"{prefix}_list_adj": F.col(value) - F.col(f"{prefix}_list_mean") + overall,
    })


def within_subject_summary(df: DataFrame, value: str, subject: str, session: str, lst: str,
                           conditions: Sequence[str], out_prefix: str = "value") -> DataFrame:
    """ST13: Cousineau-adjusted condition means with SE over subjects.

    Returns one row per condition combination: conditions..., mean_<p>, se_<p>, n_subjects.
    A NULL value makes its cell NULL (R18: the reference's mean is NA if any input is NA).
    """
    conds = list(conditions)
    unit = [subject, session, lst]
    cells = df.groupBy(*unit, *conds).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    w_list = Window.partitionBy(*unit)
    # grand mean from the (already shuffled) cell table: the scalar subquery reuses the
    # cells exchange instead of scanning and joining the raw rows a second time
    overall = cells.select(F.when(F.sum("_n") == F.sum("_rows"), F.try_divide(F.sum("_s"), F.sum("_n")))).scalar()
    # Any NULL inside the list makes the list mean NA and with it every cell of the list
    list_complete = F.sum(F.col("_rows") - F.col("_n")).over(w_list) == 0
    list_mean = F.try_divide(F.sum("_s").over(w_list), F.sum("_n").over(w_list))
    cell_complete = F.col("_rows") == F.col("_n")
    cells = cells.select(
        *unit, *conds,
        F.when(list_complete & cell_complete,
               F.try_divide(F.col("_s"), F.col("_n")) - list_mean + overall).alias("_adj"))
    # R18 again at every level: a NULL cell propagates (count(col) < count(*))
    def level(frame: DataFrame, keys: list[str]) -> DataFrame:
        return frame.groupBy(*keys, *conds).agg(
            F.when(F.count("_adj") == F.count(F.lit(1)), F.avg("_adj")).alias("_adj"))
    by_session = level(cells, [subject, session])
    by_subject = level(by_session, [subject])
    n = F.count(F.lit(1))
    return by_subject.groupBy(*conds).agg(
        F.when(F.count("_adj") == n, F.avg("_adj")).alias(f"mean_{out_prefix}"),
        F.when(F.count("_adj") == n, F.stddev_samp("_adj") / F.sqrt(n)).alias(f"se_{out_prefix}"),
        n.alias("n_subjects"),
    )
