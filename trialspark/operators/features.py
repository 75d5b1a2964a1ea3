"""Pair-level feature table.

Global centring/scaling constants (A10) are scalar subqueries over one
aggregate - Spark evaluates them once and inlines the values; there is no
cross join of a one-row frame and nothing is collected by our code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.nulls import cond_false, sentinel_to_null


def project_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """keep the given columns; a column absent from the input becomes NULL
    (fixed schema instead of the reference's per-session optional columns)."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])


def centre_scale(df: DataFrame, col: str, centre_name: str, scale_name: str, factor: float = 1.0
                 ) -> DataFrame:
    """A10 + F4/F7: centre = factor * (x - mean(x)); scale = centre / max(centre)."""
    st = df.agg(F.struct(F.avg(col).alias("m"), F.max(col).alias("mx")).alias("s")).scalar()
    centre = F.lit(factor) * (F.col(col) - st.getField("m"))
    max_centre = F.lit(factor) * (st.getField("mx") - st.getField("m"))
    return df.withColumns({centre_name: centre, scale_name: F.try_divide(centre, max_centre)})


def centre_scale_with(df: DataFrame, col: str, centre_name: str, scale_name: str, mean: Column, maximum: Column,
                      factor: float = 1.0) -> DataFrame:
    """F4/F7 with the centring constants supplied (e.g. derived in closed form elsewhere)."""
    centre = F.lit(factor) * (F.col(col) - mean)
    return df.withColumns({centre_name: centre,
                           scale_name: F.try_divide(centre, F.lit(factor) * (maximum - mean))})


def later_position_distance_constants(events: DataFrame, list_keys: Sequence[str]) -> Column:
    """Mean and maximum of |position distance| over all within-list pairs with the test item
    later than the encoding item, from list sizes alone. Positions are 1..n in each list, so
    a list of n items has n(n-1)/2 such pairs, distance sum n(n^2-1)/6 and maximum n-1 - a
    per-list count replaces a second pass over the pair table. Returns a struct (m, mx)."""
    n = F.col("n")
    sizes = events.groupBy(*list_keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.struct(
        (F.sum((n * (n * n - 1)) / 6) / F.sum((n * (n - 1)) / 2)).alias("m"),
        (F.max(n) - 1).alias("mx")).alias("st")).scalar()


def ordered_distance_constants(events: DataFrame, list_keys: Sequence[str], position: str = "serialpos") -> Column:
    """The same for positions with gaps: over all pairs of a list the distances add up to the sum of (2k - n - 1) times
    the k-th smallest position, and the largest is that of the ends."""
    w = Window.partitionBy(*list_keys)
    k = F.row_number().over(w.orderBy(position))
    n = F.count(F.lit(1)).over(w)
    per = events.select(*list_keys, F.col(position).alias("_p"), ((2 * k - n - 1) * F.col(position)).alias("_d")).groupBy(*list_keys).agg(
        F.sum("_d").alias("d"), F.count(F.lit(1)).alias("n"), (F.max("_p") - F.min("_p")).alias("far"))
    return per.agg(F.struct(F.try_divide(F.sum("d"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias("m"),
                            F.max(F.when(F.col("n") > 1, F.col("far"))).alias("mx")).alias("st")).scalar()


def split_half_distance_constants(events: DataFrame, list_keys: Sequence[str], half: int, previous: bool = False) -> Column:
    """The same for pairs of an encoding position up to ``half`` with a later test position above it; with
    ``previous`` the test position is that of the item before, so the last position of a list is not tested.
    A list of n items has m = n - half (or one less) test positions half+1..half+m, so half * m pairs with distance
    sum half * (m * half + m(m+1)/2) - m * half(half+1)/2 and maximum half + m - 1."""
    m = F.greatest(F.col("n") - half - int(previous), F.lit(0))
    sizes = events.groupBy(*list_keys).agg(F.count(F.lit(1)).alias("n")).select(m.alias("m"))
    m = F.col("m")
    total = half * (m * half + m * (m + 1) / 2) - m * (half * (half + 1) / 2)
    return sizes.agg(F.struct(F.try_divide(F.sum(total), F.sum(half * m)).alias("m"),
                              (F.max(F.when(m > 0, m)) + (half - 1)).alias("mx")).alias("st")).scalar()


def paired_position_constants(words: DataFrame, others: DataFrame, list_keys: Sequence[str], position: str) -> Column:
    """Mean and maximum of ``position`` over all within-list pairs of ``words`` with ``others``, from list sizes:
    a word counts once for every partner in its list. Returns a struct (m, mx)."""
    w = words.groupBy(*list_keys).agg(F.count(F.lit(1)).alias("nw"), F.sum(position).alias("sw"), F.max(position).alias("mw"))
    o = others.groupBy(*list_keys).agg(F.count(F.lit(1)).alias("no"))
    return w.join(o, list(list_keys)).agg(F.struct(
        F.try_divide(F.sum(F.col("sw") * F.col("no")), F.sum(F.col("nw") * F.col("no"))).alias("m"),
        F.max("mw").alias("mx")).alias("st")).scalar()


def pair_features(pairs: DataFrame, enc: str = "encoding", test: str = "encoding2",
                  test_prefix: str = "", with_category: bool = True,
                  distance_constants: Column | None = None) -> DataFrame:
    """Pair features from the two sides' event columns.

    ``test_prefix='prev_'`` compares against the item before the test event (isi period).
    Sentinels in the outpos/prev columns are NULL first (P3); comparisons with a
    missing side are False (R3).
    """
    t = lambda c: F.col(f"{test_prefix}{c}_{test}")
    e = lambda c: F.col(f"{c}_{enc}")
    out = pairs
    if with_category:
        out = out.withColumn("same_category", cond_false(e("category") == t("category")))
    out = out.withColumns({
        "serialpos_dist": e("serialpos") - t("serialpos"),
        "pair_recalled": e("recalled") + t("recalled"),
        "outpos_dist": sentinel_to_null(e("outpos"), [-999]) - sentinel_to_null(t("outpos"), [-999]),
    })
    out = out.withColumns({"abs_serialpos_dist": F.abs("serialpos_dist"),
                           "abs_outpos_dist": F.abs("outpos_dist")})
    out = out.withColumn("recall_neighbor", cond_false(F.col("abs_outpos_dist") == 1))
    if distance_constants is not None:
        return centre_scale_with(out, "abs_serialpos_dist", "abs_serialpos_dist_center", "abs_serialpos_dist_scale",
                                 distance_constants.getField("m"), distance_constants.getField("mx"))
    return centre_scale(out, "abs_serialpos_dist", "abs_serialpos_dist_center", "abs_serialpos_dist_scale")


def rename_for_period(df: DataFrame, test_period: str, enc: str = "encoding", test: str | None = None
                      ) -> DataFrame:
    """F8: period-specific names of the recall flags, booleans as nullable BOOLEAN."""
    test = test or test_period
    ren = {f"first_recalled_{enc}": "item_first", f"recalled_{enc}": "item_recalled"}
    if test_period == "encoding_isi":
        ren[f"prev_recalled_{test}"] = "item_before_isi_recalled"
    if test_period == "encoding_end":
        ren[f"recalled_{test}"] = "current_item_recalled"
    ren = {k: v for k, v in ren.items() if k in df.columns}
    out = df.withColumnsRenamed(ren)
    bools = [c for c in ["item_first", "item_recalled", "item_before_isi_recalled", "current_item_recalled"]
             if c in out.columns]
    return out.withColumns({c: F.col(c).cast("boolean") for c in bools})


def balanced_pairs(df: DataFrame, enc: str = "encoding") -> DataFrame:
    """Keep (enc position != 5 and distance > 2) or distance > 3. Applied after the
    centring of F4, as the reference does."""
    sp = F.col(f"serialpos_{enc}")
    d = F.col("abs_serialpos_dist")
    return df.where(((sp != 5) & (d > 2)) | (d > 3))


def mean_over_time(df: DataFrame, value: str = "corr_z", time_col: str = "time_distractor",
                   drop_null_keys: bool = False) -> DataFrame:
    """Average over time bins, grouping by every other column. With
    ``drop_null_keys`` rows with a NULL key are dropped (the reference's group-by, R5)."""
    keys = [c for c in df.columns if c not in (value, time_col)]
    src = df.dropna(subset=keys) if drop_null_keys else df
    return src.groupBy(*keys).agg(F.avg(value).alias(value))
