"""Effects at nested levels (ST6 over subject > session > list), each shrunk toward the level above.

One pass turns the rows into the moments of the innermost units (count, means, centred sums of squares and products).
Moments merge, so grouping sets over that table - not over the rows - give every level and the total: the sum of
squares of a union is the sum of its parts' plus n times the squared distances of their means. The table of all
levels is written once to the shared checkpoint folder, because units, their parents and the levels' variances each
read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.session import stage_table


def level_moments(df: DataFrame, levels: Sequence[str], y: str, x: str) -> DataFrame:
    """One row per unit of every level: ``depth`` (0 = all rows, then one more for each level), the levels' keys
    (NULL below the unit's own level), n, sxx, sxy, syy (centred)."""
    levels = list(levels)
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.select(*levels, xs.alias("_x"), ys.alias("_y")).dropna()
    base = rows.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.var_pop("_x").alias("vx"),
        F.covar_pop("_x", "_y").alias("vxy"), F.var_pop("_y").alias("vy"))
    n = F.col("n")

    def merged(inner: str, a: str, b: str):
        return F.sum(n * F.col(inner) + n * F.col(a) * F.col(b)) - F.sum(n * F.col(a)) * F.sum(n * F.col(b)) / F.sum(n)
    sets = [levels[:k] for k in range(len(levels) + 1)]
    out = base.groupingSets(sets, *levels).agg(
        F.sum(n).alias("n"), merged("vx", "mx", "mx").alias("sxx"), merged("vxy", "mx", "my").alias("sxy"), merged("vy", "my", "my").alias("syy"),
        (F.lit(len(levels)) - F.bit_count(F.grouping_id())).cast("int").alias("depth"))
    return out


def nested_effects(df: DataFrame, levels: Sequence[str], y: str, x: str) -> DataFrame:
    """ST6 at every level: the slope of ``y`` on ``x`` in each unit, its standard error from the level's pooled
    residual variance, and the slope shrunk toward that of the unit it lies in, with weight
    tau2 / (tau2 + se^2). tau2, the variance between units of a level around their parents, is the mean squared
    distance less the mean squared error, at least 0.

    Returns level (name), the levels' keys, n, slope, se, shrunk. A unit without variation in ``x`` has no slope and
    takes its parent's whole.
    """
    levels = list(levels)
    units = stage_table(level_moments(df, levels, y, x), f"level-moments-{uuid.uuid4().hex}")
    # sums of squares below rounding are none
    slope = F.when((F.col("n") > 1) & (F.col("sxx") > 1e-9 * F.col("n")), F.col("sxy") / F.col("sxx"))
    units = units.withColumn("slope", slope)
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    free = F.when(F.col("slope").isNotNull() & (F.col("n") > 2), F.col("n") - 2)
    pooled = units.groupBy("depth").agg(F.try_divide(F.sum(F.when(free.isNotNull(), rss)), F.sum(free)).alias("s2"))
    own = units.where("depth > 0").join(F.broadcast(pooled), "depth").withColumn("se2", F.when(F.col("slope").isNotNull(), F.col("s2") / F.col("sxx")))

    up = units.where(F.col("depth") < len(levels)).select(
        (F.col("depth") + 1).alias("_depth"), *[F.col(k).alias(f"_{k}") for k in levels[:-1]], F.col("slope").alias("above"))
    same = [F.col("depth") == F.col("_depth")]
    # a parent's keys end one level above: below them both sides compare NULL
    same += [F.when(F.col("depth") > i + 1, F.col(k)).eqNullSafe(F.col(f"_{k}")) for i, k in enumerate(levels[:-1])]
    own = own.join(up, same, "left").drop("_depth", *[f"_{k}" for k in levels[:-1]])
    gap = F.col("slope") - F.col("above")
    between = own.where(gap.isNotNull()).groupBy("depth").agg(F.greatest(F.avg(gap * gap) - F.avg("se2"), F.lit(0.0)).alias("tau2"))
    out = own.join(F.broadcast(between), "depth", "left")
    weight = F.coalesce(F.try_divide(F.col("tau2"), F.col("tau2") + F.col("se2")), F.lit(0.0))
    shrunk = F.when(F.col("slope").isNull(), F.col("above")).when(F.col("above").isNull(), F.col("slope")).otherwise(
        weight * F.col("slope") + (1 - weight) * F.col("above"))
    name = F.element_at(F.array(*[F.lit(k) for k in levels]), F.col("depth"))
    return out.select(name.alias("level"), *levels, "n", "slope", F.sqrt("se2").alias("se"), shrunk.alias("shrunk"))
