"""Statistics re-aimed as distributed jobs (ST1-ST12, ST14).

The reference fits crossed random-effects mixed models on one machine. Here the
heavy part of every question is a Spark aggregation and only matrices of
p x p (p = number of fixed-effect columns, tens at most) reach the driver:

* ST5 fixed effects: one partial aggregation of the Gram matrix X'X, X'y, y'y
  (sums of products computed on executors, combined map-side), then a p x p
  solve. Results are ordinary least squares, not the reference's REML mixed
  model - estimates coincide for balanced designs, standard errors do not.
* ST6 per-group effects: the same sums per group (groupBy, partial aggregation,
  so a hot group is pre-aggregated across tasks) and a small solve per group in
  a vectorised pandas function over the aggregated rows - raw rows of a group
  are never gathered in one place.
* ST7 variance by level: nested sums of squares from (n, sum, sum of squares) at
  the list level, rolled up with further group-bys.
* ST9 marginal means with cell weights: cell counts and means by groupBy; the
  cell-weighted mean of a saturated cell model at a level is the mean over its
  rows; standard errors use the pooled residual variance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# ST1 / ST2 / ST4 helpers
# ---------------------------------------------------------------------------


def standardise(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """ST1: (x - mean) / sd with ddof=1 over the whole table (scalar subquery, no cross join)."""
    st = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).alias("st")).scalar()
    return df.withColumn(out or col, F.try_divide(F.col(col) - st.getField("m"), st.getField("s")))


def scale_constants(df: DataFrame, col: str) -> tuple[float, float]:
    """Mean and sd (ddof=1) of a column, as numbers (used to unstandardise small result tables)."""
    r = df.agg(F.avg(col), F.stddev_samp(col)).first()
    return float(r[0]), float(r[1])


def as_factor(df: DataFrame, col: str) -> DataFrame:
    """ST2: a position used as a category."""
    return df.withColumn(col, F.col(col).cast("string"))


def design_columns(terms: Sequence[Sequence[str]], coding: str = "treatment",
                   covariates: Sequence[str] = ()) -> dict[str, Column]:
    """ST4: design columns from terms; a term is a tuple of 0/1 (or numeric) column names and
    its column is their product (``a:b``); ``()`` is the intercept. ``coding='sum'`` maps a
    0/1 factor to -1/2, +1/2 (used for type III tests); numeric ``covariates`` stay as they are."""
    cols: dict[str, Column] = {}
    for t in terms:
        name = ":".join(t) if t else "(Intercept)"
        c = F.lit(1.0)
        for v in t:
            x = F.col(v).cast("double")
            if coding == "sum" and v not in covariates:
                x = x - F.lit(0.5)
            c = c * x
        cols[name] = c
    return cols


def expand_interactions(factors: Sequence[str]) -> list[tuple[str, ...]]:
    """All main effects and interactions of the factors (``a*b*c``), intercept first."""
    from itertools import combinations
    terms: list[tuple[str, ...]] = [()]
    for k in range(1, len(factors) + 1):
        terms.extend(combinations(factors, k))
    return terms


# ---------------------------------------------------------------------------
# ST5 fixed effects by normal equations
# ---------------------------------------------------------------------------

def gram(df: DataFrame, y: str, design: dict[str, Column], standardise: bool = False
         ) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n over complete rows, as one Spark aggregate (one row to the driver).

    ``standardise=True`` fits scale(y) (ST1, ddof=1) without a second pass: the same
    aggregate also returns sum(y) and the column sums of X, and the standardised moments
    follow algebraically: X'z = (X'y - mean * X'1) / sd, z'z = n - 1.
    """
    names = list(design)
    x = df.select(*[design[n].alias(f"_x{i}") for i, n in enumerate(names)],
                  F.col(y).cast("double").alias("_y")).dropna()
    p = len(names)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"),
            F.sum("_y").alias("sy")]
    for i in range(p):
        aggs.append(F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"xy{i}"))
        aggs.append(F.sum(F.col(f"_x{i}")).alias(f"x{i}"))
        for j in range(i, p):
            aggs.append(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"xx{i}_{j}"))
    r = x.agg(*aggs).first().asDict()
    xtx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            xtx[i, j] = xtx[j, i] = r[f"xx{i}_{j}"] or 0.0
    xty = np.array([r[f"xy{i}"] or 0.0 for i in range(p)])
    n, yy, sy = int(r["n"]), float(r["yy"] or 0.0), float(r["sy"] or 0.0)
    if standardise:
        mean = sy / n
        sd = math.sqrt((yy - sy * mean) / (n - 1))
        xsum = np.array([r[f"x{i}"] or 0.0 for i in range(p)])
        xty = (xty - mean * xsum) / sd
        yy = float(n - 1)
    return xtx, xty, yy, n


def _normal_cdf(z: float) -> float:
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


def ols_from_gram(names: list[str], xtx: np.ndarray, xty: np.ndarray, yy: float, n: int) -> pd.DataFrame:
    p = len(names)
    beta = np.linalg.solve(xtx, xty)
    rss = max(yy - 2 * beta @ xty + beta @ xtx @ beta, 0.0)
    dof = n - p
    s2 = rss / dof if dof > 0 else float("nan")
    cov = s2 * np.linalg.inv(xtx)
    se = np.sqrt(np.diag(cov))
    t = beta / se
    pval = [2 * (1 - _normal_cdf(abs(v))) for v in t]  # large-sample normal reference
    return pd.DataFrame({"term": names, "estimate": beta, "se": se, "t": t, "p_normal": pval,
                         "df": [dof] * p, "rss": [rss] * p})


def fit_fixed_effects(df: DataFrame, y: str, terms: Sequence[Sequence[str]], standardise: bool = False
                      ) -> DataFrame:
    """ST5: OLS coefficients, SE, t and a normal-reference p value for the fixed part
    (of scale(y) when ``standardise``, in the same single pass)."""
    design = design_columns(terms)
    xtx, xty, yy, n = gram(df, y, design, standardise)
    res = ols_from_gram(list(design), xtx, xty, yy, n)
    return df.sparkSession.createDataFrame(res)


def type3_tests(df: DataFrame, y: str, terms: Sequence[Sequence[str]], standardise: bool = False,
                covariates: Sequence[str] = ()) -> DataFrame:
    """ST8: F test of each term (0/1 factors coded to sum to zero, numeric ``covariates`` unshifted)
    from reduced-vs-full residual sums of squares, all taken from one aggregated Gram matrix."""
    design = design_columns(terms, coding="sum", covariates=covariates)
    names = list(design)
    xtx, xty, yy, n = gram(df, y, design, standardise)

    def rss(idx: list[int]) -> float:
        a = xtx[np.ix_(idx, idx)]
        b = xty[idx]
        beta = np.linalg.solve(a, b)
        return float(yy - beta @ b)

    full_idx = list(range(len(names)))
    rss_full = rss(full_idx)
    dof = n - len(names)
    rows = []
    for i, name in enumerate(names):
        if name == "(Intercept)":
            continue
        red = rss([j for j in full_idx if j != i])
        f = ((red - rss_full) / 1.0) / (rss_full / dof) if dof > 0 else float("nan")
        rows.append((name, 1, dof, float(red - rss_full), float(f)))
    return df.sparkSession.createDataFrame(rows, "term string, num_df long, den_df long, ss double, f double")


# ---------------------------------------------------------------------------
# ST6 per-group effects
# ---------------------------------------------------------------------------

def per_group_effects(df: DataFrame, group: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """ST6: OLS of y on [1, xs] within each group. Groups whose design is singular get NULL
    coefficients and a reason. Returns one row per group: group keys, n, b_intercept, b_<x>...

    One pass: per group, Spark's built-in centred aggregates (``covar_pop``, ``avg`` - merged
    with a numerically stable update, partially aggregated before the shuffle) give the
    covariance matrix of the covariates and their covariance with y; slopes solve
    Cov(x, x) b = Cov(x, y) and the intercept is mean(y) - b . mean(x). Only these p x p
    moments per group reach the vectorised pandas solve - never the group's rows.
    """
    group, xs = list(group), list(xs)
    p = len(xs)
    src = df.select(*group, *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)],
                    F.col(y).cast("double").alias("_y")).dropna()
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("_y").alias("my")]
    for i in range(p):
        aggs.append(F.avg(f"_x{i}").alias(f"mx{i}"))
        aggs.append(F.covar_pop(f"_x{i}", "_y").alias(f"cxy{i}"))
        for j in range(i, p):
            aggs.append(F.covar_pop(f"_x{i}", f"_x{j}").alias(f"cxx{i}_{j}"))
    moments = src.groupBy(*group).agg(*aggs)
    out_fields = ", ".join(f"`b_{x}` double" for x in xs)
    schema = (f"{', '.join(f'`{g}` ' + _type_of(df, g) for g in group)}, n long, "
              f"`b_intercept` double, {out_fields}, reason string")

    def solve(batches):
        for pdf in batches:
            m = len(pdf)
            cxx = np.zeros((m, p, p))
            for i in range(p):
                for j in range(i, p):
                    cxx[:, i, j] = cxx[:, j, i] = pdf[f"cxx{i}_{j}"].to_numpy(dtype=float)
            cxy = np.stack([pdf[f"cxy{i}"].to_numpy(dtype=float) for i in range(p)], axis=1)
            mx = np.stack([pdf[f"mx{i}"].to_numpy(dtype=float) for i in range(p)], axis=1)
            scale = np.maximum(np.abs(cxx).max(axis=(1, 2)), 1e-300) ** p
            ok = np.abs(np.linalg.det(cxx)) > 1e-12 * scale
            beta = np.full((m, p), np.nan)
            if ok.any():
                beta[ok] = np.linalg.solve(cxx[ok], cxy[ok][..., None])[..., 0]
            out = pdf[group].copy()
            out["n"] = pdf["n"].astype("int64")
            out["b_intercept"] = pdf["my"].to_numpy(dtype=float) - np.einsum("ij,ij->i", beta, mx)
            for k, x in enumerate(xs):
                out[f"b_{x}"] = beta[:, k]
            out["reason"] = np.where(ok, None, "singular design")
            yield out

    res = moments.mapInPandas(solve, schema)
    bcols = ["b_intercept", *[f"b_{x}" for x in xs]]
    return res.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in bcols})


def _type_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def mean_se(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and SE = sd / sqrt(n) over units."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg(col).alias(f"mean_{col}"),
                 (F.stddev_samp(col) / F.sqrt(F.count(col))).alias(f"se_{col}"),
                 F.count(col).alias("n_groups"))


# ---------------------------------------------------------------------------
# ST7 variance by nested level
# ---------------------------------------------------------------------------

def variance_by_level(df: DataFrame, y: str, levels: Sequence[str], standardise: bool = False) -> DataFrame:
    """ST7: between-unit sums of squares at each nesting level plus the residual
    (within the innermost unit). The parts add up to the total sum of squares.
    ``standardise`` reports them for scale(y): every part divided by the sample variance,
    which comes from the same innermost-unit aggregate (no second pass over the rows)."""
    levels = list(levels)
    base = df.where(F.col(y).isNotNull()).groupBy(*levels).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    # every level's units in one pass over the innermost units; depth 0 is the whole table
    sets = [levels[:k] for k in range(len(levels) + 1)]
    units = base.groupingSets(sets, *levels).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        (F.lit(len(levels)) - F.bit_count(F.grouping_id())).alias("depth"))
    # the rows' own level stands one below the innermost units: its "explained" part is the raw sum of squares
    per = units.groupBy("depth").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("a"), F.count(F.lit(1)).alias("units"),
                                     F.sum("n").alias("n"), F.sum("ss").alias("raw"))
    k = len(levels)
    per = per.select(F.explode(F.when(F.col("depth") == k, F.array(
        F.struct(F.col("depth"), F.col("a"), F.col("units")), F.struct((F.col("depth") + 1).alias("depth"), F.col("raw").alias("a"), F.col("n").alias("units"))))
        .otherwise(F.array(F.struct(F.col("depth"), F.col("a"), F.col("units"))))).alias("r")).select("r.*")
    # sum of squares between units of a level inside those of the level above: a handful of rows, one for each level
    steps = Window.orderBy("depth")
    ends = steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ss = F.col("a") - F.lag("a").over(steps)
    if standardise:
        total = F.last("a").over(ends) - F.first("a").over(ends)
        ss = F.try_divide(ss, F.try_divide(total, F.last("units").over(ends) - 1))
    name = F.element_at(F.array(*[F.lit(v) for v in [*levels, "residual"]]), F.greatest(F.col("depth"), F.lit(1)).cast("int"))
    out = per.select("depth", name.alias("level"), (F.col("units") - F.lag("units").over(steps)).cast("bigint").alias("df"), ss.alias("ss"))
    return out.where("depth > 0").select("level", "df", "ss")


# ---------------------------------------------------------------------------
# ST9-ST12 marginal means and contrasts (saturated cell model, cell weights)
# ---------------------------------------------------------------------------

def cell_table(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Counts, sums and sums of squares per cell of the factors (one partial aggregation)."""
    return df.where(F.col(y).isNotNull()).groupBy(*factors).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))


def marginal_means(df: DataFrame, y: str, factors: Sequence[str], at: str, by: Sequence[str],
                   extra_keys: Sequence[str] = ()) -> DataFrame:
    """ST9: cell-weighted marginal mean of y at each level of ``at`` within each stratum ``by``
    for the saturated model over ``factors`` (extra_keys are analysis groups such as a
    dropped frequency). Returns keys, at, emmean, se, n; SE uses the pooled residual variance
    of the cell model within each analysis group."""
    keys = list(extra_keys)
    cells = cell_table(df, y, [*keys, *factors])
    resid = cells.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")),
                     F.sum("n") - F.count(F.lit(1))).alias("_s2")) if keys else None
    mm = cells.groupBy(*keys, *by, at).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    if keys:
        mm = mm.join(resid, keys, "left")
    else:
        s2 = cells.agg(F.try_divide(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")),
                                    F.sum("n") - F.count(F.lit(1))).alias("s2")).scalar()
        mm = mm.withColumn("_s2", s2)
    return mm.select(*keys, *by, at, (F.col("s") / F.col("n")).alias("emmean"),
                     F.sqrt(F.col("_s2") / F.col("n")).alias("se"), "n")


def cell_marginal_means(df: DataFrame, value: str, factors: Sequence[str], at: str, by: Sequence[str] = ()
                        ) -> DataFrame:
    """ST1 + ST9 in one pass: marginal means of scale(value) at each level of ``at`` within
    strata ``by`` for the saturated cell model over ``factors``, cell-count weighted, with
    SE from the pooled residual variance. One aggregation of raw sums per cell; the global
    mean/sd and the standardised cell statistics follow algebraically on the cell table
    (bounded by the product of the factor levels). Returns by, at, emmean, se, n, _m, _s."""
    factors, by = list(factors), list(by)
    cells = df.where(F.col(value).isNotNull()).groupBy(*factors).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    tot = cells.agg(F.struct(
        (F.sum("s1") / F.sum("n")).alias("m"),
        F.sqrt(F.try_divide(F.sum("s2") - F.sum("s1") * F.sum("s1") / F.sum("n"), F.sum("n") - 1)).alias("s"),
        F.try_divide(F.sum(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")),
                     F.sum("n") - F.count(F.lit(1))).alias("s2w"))).scalar()
    m, sd, s2w = tot.getField("m"), tot.getField("s"), tot.getField("s2w")
    mm = cells.groupBy(*by, at).agg(F.sum("s1").alias("s1"), F.sum("n").alias("n"))
    return mm.select(*by, at, F.try_divide(F.col("s1") / F.col("n") - m, sd).alias("emmean"),
                     F.sqrt(F.try_divide(s2w, sd * sd) / F.col("n")).alias("se"), "n",
                     m.alias("_m"), sd.alias("_s"))


def standardised_cell_means(df: DataFrame, value: str, keys: Sequence[str], factor: str) -> DataFrame:
    """ST1 + ST9 for a one-factor cell model fitted separately per ``keys`` group, with the
    response standardised (ddof=1) within each group.

    Standardisation is linear, so everything derives from one aggregation of raw sums per
    (keys, factor) cell: group mean and sd, cell means and the pooled residual variance of
    the standardised response. The input is read once; the rest works on the cell table.
    Returns keys, factor, emmean, se, n, and the group's ``_m``/``_s`` for unstandardising.
    """
    keys = list(keys)
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, factor).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    w = Window.partitionBy(*keys)
    n_tot, s1_tot, s2_tot = F.sum("n").over(w), F.sum("s1").over(w), F.sum("s2").over(w)
    g = cells.withColumns({
        "_m": s1_tot / n_tot,
        "_s": F.sqrt(F.try_divide(s2_tot - s1_tot * s1_tot / n_tot, n_tot - 1)),
        "_ss_within": F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"),
        "_cells": F.count(F.lit(1)).over(w),
        "_n_tot": n_tot,
    })
    g = g.withColumn("_s2y", F.try_divide(F.try_divide(F.sum("_ss_within").over(w), F.col("_s") * F.col("_s")),
                                          F.col("_n_tot") - F.col("_cells")))
    return g.select(*keys, factor, F.try_divide(F.col("s1") / F.col("n") - F.col("_m"), F.col("_s")).alias("emmean"),
                    F.sqrt(F.col("_s2y") / F.col("n")).alias("se"), "n", "_m", "_s")


def revpairwise(mm: DataFrame, at: str, hi, lo, by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """ST9 contrast: level ``hi`` minus level ``lo`` of ``at`` within each stratum (a
    self-join of the marginal-mean table on the strata). SE assumes independent cells."""
    k = [*keys, *by]
    a = mm.where(F.col(at) == hi).select(*k, F.col("emmean").alias("_a"), F.col("se").alias("_sa"))
    b = mm.where(F.col(at) == lo).select(*k, F.col("emmean").alias("_b"), F.col("se").alias("_sb"))
    j = a.join(b, [a[c].eqNullSafe(b[c]) for c in k], "inner").select(
        *[a[c] for c in k], (F.col("_a") - F.col("_b")).alias("estimate"),
        F.sqrt(F.col("_sa") * F.col("_sa") + F.col("_sb") * F.col("_sb")).alias("se"))
    return j


def comparison_bars(df: DataFrame, est: str, lower: str, upper: str) -> DataFrame:
    """ST10: symmetric error bar = the larger of the two arrow lengths (NULLs skipped)."""
    return df.withColumn("SE", F.greatest(F.col(est) - F.col(lower), F.col(upper) - F.col(est)))


def unstandardise(df: DataFrame, cols: dict[str, str], mean: float | Column, sd: float | Column,
                  contrast: bool = False) -> DataFrame:
    """ST11: estimate * sd + mean (contrasts and SEs: * sd only)."""
    m = mean if isinstance(mean, Column) else F.lit(mean)
    s = sd if isinstance(sd, Column) else F.lit(sd)
    out = {}
    for src, dst in cols.items():
        out[dst] = F.col(src) * s if (contrast or src.startswith("se")) else F.col(src) * s + m
    return df.withColumns(out)


def logistic_fixed_effects(df: DataFrame, y: str, xs: Sequence[str], max_iter: int = 25) -> DataFrame:
    """ST14: binomial GLM (logit link) fitted with Spark ML (distributed IRLS)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = df.select(*[F.col(x).cast("double").alias(x) for x in xs],
                     F.col(y).cast("double").alias("label")).dropna()
    data = VectorAssembler(inputCols=list(xs), outputCol="features").transform(data)
    # iterative (IRLS) fit: its input is materialised once in the shared checkpoint folder
    from trialspark.session import staged
    with staged(data) as data:
        model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=max_iter,
                                            regParam=0.0).fit(data)
        s = model.summary
        if s.numIterations >= max_iter:
            raise RuntimeError(f"the logistic fit did not converge in {max_iter} iterations")
        names = ["(Intercept)", *xs]
        est = [model.intercept, *model.coefficients.toArray().tolist()]
        # summary order: coefficients then intercept
        se = s.coefficientStandardErrors
        se = [se[-1], *se[:-1]]
        t = s.tValues
        t = [t[-1], *t[:-1]]
    rows = list(zip(names, [float(v) for v in est], [float(v) for v in se], [float(v) for v in t]))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, z double")


def frequency_labels(spark: SparkSession, labels: Sequence[float]) -> DataFrame:
    """ST12 lookup: dropped-frequency index -> rounded Hz label (a fixed 8-row table)."""
    return F.broadcast(spark.createDataFrame([(i, float(v)) for i, v in enumerate(labels)],
                                             "drop_freq long, dropped_freq_hz double"))
