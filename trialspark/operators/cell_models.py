"""Linear models from cell moments (ST2, ST4, ST5, ST8-ST10): formula to design, fit, marginal means, F tests.

The factors of a model cut its rows into cells. One partially aggregated Spark job turns the rows into a row per
cell (counts, sums, sums of squares and products with the covariates); the Gram matrix, with one block of columns
for each term, follows from these alone, so every answer here is a function of a table bounded by the product of
the factors' levels. That table is solved per analysis group in a grouped pandas function: nothing is collected
while the query is built, and groups (dropped frequencies, periods) are solved in parallel.

Fits are ordinary least squares of the response, standardised over the group's rows if wanted (ST1).
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from trialspark.operators.stats import _normal_cdf, comparison_bars, unstandardise

# two-sided 5 % point of the normal distribution (fixed value)
Z_95 = 1.959963984540054


# ---------------------------------------------------------------------------
# ST4: formula text to terms
# ---------------------------------------------------------------------------

def formula_terms(formula: str | Sequence[Sequence[str]]) -> list[tuple[str, ...]]:
    """The terms of a fixed-effect formula, intercept first, then by degree in order of appearance. ``+``, ``*``,
    ``:``, ``^k`` and removal by ``-`` as in R; term tuples pass through."""
    if not isinstance(formula, str):
        return [tuple(t) for t in formula]
    order = {}

    def expand(node) -> dict[frozenset, None]:
        if isinstance(node, ast.Name):
            order.setdefault(node.id, len(order))
            return {frozenset([node.id]): None}
        if isinstance(node, ast.Constant):
            return {frozenset(): None} if node.value == 1 else {}
        left = expand(node.left)
        if isinstance(node.op, ast.Pow) and isinstance(node.right, ast.Constant):
            out = left
            for _ in range(node.right.value - 1):
                out = out | {a | b: None for a in out for b in left}
            return out
        right = expand(node.right)
        if isinstance(node.op, ast.Add):
            return left | right
        if isinstance(node.op, ast.Sub):
            return {t: None for t in left if t not in right}
        crossed = {a | b: None for a in left for b in right}
        return crossed if isinstance(node.op, ast.Pow) else left | right | crossed

    # ':' and '^' bind tighter than '*', as '**' does
    body = ast.parse("1 + " + formula.replace(":", "**").replace("^", "**"), mode="eval").body
    names = [sorted(t, key=order.get) for t in expand(body)]
    return [tuple(t) for t in sorted(names, key=len)]


def variables(terms: Sequence[Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(v for t in terms for v in t))


# ---------------------------------------------------------------------------
# cells
# ---------------------------------------------------------------------------

@dataclass
class Model:
    """A response, the terms, and which variables are factors; the others are covariates (floating-point columns),
    at most one in a term."""
    y: str
    terms: list[tuple[str, ...]]
    factors: list[str]
    covariates: list[str]
    keys: list[str] = field(default_factory=list)
    standardise: bool = True


def model(df: DataFrame, y: str, formula, keys: Sequence[str] = (), factors: Sequence[str] = (), standardise: bool = True) -> Model:
    """The model of ``formula`` over the columns of ``df``: floating-point columns are covariates unless named in
    ``factors`` (ST2), any other column is a factor."""
    terms = formula_terms(formula)
    names = variables(terms)
    missing = [v for v in names if v not in df.columns]
    if missing:
        raise ValueError(f"formula names columns that do not exist: {missing}")
    numeric = [v for v in names if v not in factors and isinstance(df.schema[v].dataType, (DoubleType, FloatType))]
    if any(sum(v in numeric for v in t) > 1 for t in terms):
        raise ValueError("a term may hold one covariate")
    return Model(y, terms, [v for v in names if v not in numeric], numeric, list(keys), standardise)


def cells(df: DataFrame, m: Model) -> DataFrame:
    """One row per cell of (keys, factors): n, and the sums of 1, y, the covariates and their products over the
    rows that are complete."""
    needed = [m.y, *m.factors, *m.covariates]
    lanes = {"y": F.col(m.y).cast("double")} | {f"v{i}": F.col(v).cast("double") for i, v in enumerate(m.covariates)}
    sums = [F.sum(c).alias(f"s_{a}") for a, c in lanes.items()]
    sums += [F.sum(lanes[a] * lanes[b]).alias(f"s_{a}_{b}") for a, b in combinations(lanes, 2)]
    sums += [F.sum(c * c).alias(f"s_{a}_{a}") for a, c in lanes.items()]
    whole = df.dropna(subset=needed).where(~F.isnan(F.col(m.y).cast("double")))
    return whole.groupBy(*m.keys, *m.factors).agg(F.count(F.lit(1)).alias("n"), *sums)


# ---------------------------------------------------------------------------
# the fit of one group's cells
# ---------------------------------------------------------------------------

class Fit:
    """Least squares over a group's cells. Column blocks stand in the order of the terms; columns that depend on
    earlier ones get no coefficient (``known`` is False)."""

    def __init__(self, m: Model, table: pd.DataFrame, coding: str = "treatment"):
        self.m, self.table, self.coding = m, table, coding
        self.levels = {f: sorted(table[f].unique().tolist()) for f in m.factors}
        self.n = float(table["n"].sum())
        self.covariate_mean = {v: table[f"s_v{i}"].sum() / self.n for i, v in enumerate(m.covariates)}
        x, lane = self.design(table)
        self.lane = lane
        self.columns = [c for t in m.terms for c in self._names(t)]
        self.block = np.repeat(np.arange(len(m.terms)), [len(self._names(t)) for t in m.terms])

        def moment(a, b):
            if a is None and b is None:
                return table["n"].to_numpy(float)
            if a is None or b is None:
                return table[f"s_{a or b}"].to_numpy(float)
            a, b = sorted((a, b), key=lambda c: (c != "y", c))
            return table[f"s_{a}_{b}"].to_numpy(float)
        p = len(lane)
        self.xx, self.xy, self.x1 = np.zeros((p, p)), np.zeros(p), np.zeros(p)
        for a in set(lane):
            i = [k for k in range(p) if lane[k] == a]
            self.xy[i] = x[:, i].T @ moment(a, "y")
            self.x1[i] = x[:, i].T @ moment(a, None)
            for b in set(lane):
                j = [k for k in range(p) if lane[k] == b]
                self.xx[np.ix_(i, j)] = x[:, i].T @ (x[:, j] * moment(a, b)[:, None])
        self.mean, sy, self.yy = 0.0, table["s_y"].sum(), table["s_y_y"].sum()
        self.sd = 1.0
        if m.standardise:
            self.mean = sy / self.n
            self.sd = float(np.sqrt((self.yy - sy * self.mean) / (self.n - 1))) if self.n > 1 else np.nan
            self.xy = (self.xy - self.mean * self.x1) / self.sd
            self.yy = self.n - 1
        self.known = self._independent()
        self.inverse = np.zeros((p, p))
        keep = np.flatnonzero(self.known)
        self.inverse[np.ix_(keep, keep)] = np.linalg.inv(self.xx[np.ix_(keep, keep)])
        self.beta = self.inverse @ self.xy
        self.rss = max(self.yy - self.beta @ self.xy, 0.0)
        self.dof = self.n - len(keep)
        self.s2 = self.rss / self.dof if self.dof > 0 else np.nan

    def _contrasts(self, f: str, values) -> np.ndarray:
        levels = self.levels[f]
        hit = np.array([[v == u for u in levels] for v in values], dtype=float)
        return hit[:, 1:] if self.coding == "treatment" else hit[:, :-1] - hit[:, -1:]

    def _names(self, term) -> list[str]:
        """A boolean factor's column bears its name, another factor's its level as well."""
        parts = []
        for v in term:
            if v in self.m.covariates or set(self.levels[v]) <= {False, True}:
                parts.append([v] * (1 if v in self.m.covariates else len(self.levels[v]) - 1))
            else:
                parts.append([f"{v}[{u}]" for u in (self.levels[v][1:] if self.coding == "treatment" else self.levels[v][:-1])])
        return [":".join(c) or "(Intercept)" for c in product(*parts)]

    def design(self, rows: pd.DataFrame) -> tuple[np.ndarray, list]:
        """The factor part of every design column for ``rows`` of factor levels, and each column's covariate lane."""
        blocks, lanes = [], []
        for term in self.m.terms:
            block = np.ones((len(rows), 1))
            for v in term:
                if v not in self.m.covariates:
                    c = self._contrasts(v, rows[v])
                    block = (block[:, :, None] * c[:, None, :]).reshape(len(rows), -1)
            blocks.append(block)
            lane = [f"v{self.m.covariates.index(v)}" for v in term if v in self.m.covariates]
            lanes += [lane[0] if lane else None] * block.shape[1]
        return np.concatenate(blocks, axis=1), lanes

    def _independent(self) -> np.ndarray:
        """Columns that add to the ones before them, by elimination on the scaled Gram matrix."""
        scale = np.sqrt(np.maximum(np.diag(self.xx), 1e-300))
        a = self.xx / scale[:, None] / scale[None, :]
        known = np.zeros(len(a), dtype=bool)
        for k in range(len(a)):
            if a[k, k] > 1e-9:
                known[k] = True
                a = a - np.outer(a[:, k], a[k]) / a[k, k]
        return known

    def at_means(self, rows: pd.DataFrame) -> np.ndarray:
        """Design rows with every covariate at its mean."""
        x, lane = self.design(rows)
        means = {f"v{i}": self.covariate_mean[v] for i, v in enumerate(self.m.covariates)}
        return x * np.array([1.0 if a is None else means[a] for a in lane])

    def rss_without(self, drop: np.ndarray) -> float:
        keep = np.flatnonzero(self.known & ~drop)
        b = np.linalg.solve(self.xx[np.ix_(keep, keep)], self.xy[keep])
        return float(self.yy - b @ self.xy[keep])


def _per_group(df: DataFrame, m: Model, function: Callable[[Fit], pd.DataFrame], schema: str, coding: str = "treatment") -> DataFrame:
    """``function`` of the fit of every group of ``keys``, as rows with the keys in front."""
    table = cells(df, m)
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in m.keys)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        out = function(Fit(m, group, coding))
        for k in reversed(m.keys):
            out.insert(0, k, group[k].iloc[0])
        return out
    return table.groupBy(*m.keys).applyInPandas(solve, f"{types + ', ' if types else ''}{schema}")


# ---------------------------------------------------------------------------
# ST5, ST8, ST9, ST10
# ---------------------------------------------------------------------------

def coefficients(df: DataFrame, m: Model) -> DataFrame:
    """ST5: term, estimate, se, t, p_normal (normal reference); NULL for a column without a coefficient."""
    def rows(f: Fit) -> pd.DataFrame:
        se = np.sqrt(np.maximum(f.s2 * np.diag(f.inverse), 0))
        t = np.divide(f.beta, se, out=np.full_like(se, np.nan), where=se > 0)
        values = pd.DataFrame({"estimate": f.beta, "se": se, "t": t, "p_normal": [2 * (1 - _normal_cdf(abs(v))) for v in t]})
        values[~f.known] = np.nan
        return pd.concat([pd.DataFrame({"term": f.columns}), values.astype(object).where(values.notna(), None)], axis=1)
    return _per_group(df, m, rows, "term string, estimate double, se double, t double, p_normal double")


def type3_tests(df: DataFrame, m: Model) -> DataFrame:
    """ST8: for every term but the intercept the F test of its whole block of columns, factors coded to sum to
    zero: the rise of the residual sum of squares without the block. num_df counts the block's own columns."""
    def rows(f: Fit) -> pd.DataFrame:
        out = []
        for k, term in enumerate(m.terms):
            drop = f.block == k
            q = int((drop & f.known).sum())
            if term and q:
                ss = f.rss_without(drop) - f.rss
                out.append((":".join(term), q, int(f.dof), ss, ss / q / f.s2 if f.s2 > 0 else None))
        return pd.DataFrame(out, columns=["term", "num_df", "den_df", "ss", "f"])
    return _per_group(df, m, rows, "term string, num_df long, den_df long, ss double, f double", coding="sum")


def marginal_means(df: DataFrame, m: Model, at: str, by: Sequence[str] = ()) -> DataFrame:
    """ST9: means of the fitted model at each level of ``at`` within the strata ``by``, and their reverse pairwise
    contrasts.

    The reference grid holds the cells that occur: a factor nested in others (it varies only at some of their
    levels) has no empty cells there. A mean weighs the grid's cells by their rows, L = sum(n x) / sum(n) with
    covariates at their means; estimates are L b, errors come from L V L' with the fit's covariance V, and a
    contrast's error from the difference of its two rows of L, so means that share coefficients do not count
    as independent.

    ``kind`` is mean or contrast, ``level`` the level of ``at`` or 'high - low'. ``lower`` and ``upper`` are the
    ends of a mean's comparison arrows (ST10): towards the next mean of the stratum, each half of the difference
    that would be significant; NULL where no mean lies on that side.
    """
    by = list(by)
    types = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)

    def rows(f: Fit) -> pd.DataFrame:
        x = f.at_means(f.table)
        x[:, ~f.known] = 0.0
        weight = f.table["n"].to_numpy(float)
        cov = f.s2 * f.inverse
        out = []
        groups = f.table.groupby(by, dropna=False, sort=True).indices if by else {(): np.arange(len(f.table))}
        for stratum, rows_in in groups.items():
            stratum = stratum if isinstance(stratum, tuple) else (stratum,)
            here = f.table[at].to_numpy()[rows_in]
            lines = {}
            for u in sorted(set(here.tolist())):
                i = rows_in[here == u]
                lines[u] = (weight[i] @ x[i] / weight[i].sum(), weight[i].sum())
            means = {u: float(line @ f.beta) for u, (line, _) in lines.items()}
            arrow = {u: [None, None] for u in lines}
            order = sorted(lines, key=means.get)
            for lo, hi in zip(order[:-1], order[1:]):
                d = lines[hi][0] - lines[lo][0]
                half = Z_95 * float(np.sqrt(max(d @ cov @ d, 0.0))) / 2
                arrow[lo][1], arrow[hi][0] = means[lo] + half, means[hi] - half
            for u, (line, n) in lines.items():
                out.append((*stratum, "mean", str(u), means[u], float(np.sqrt(line @ cov @ line)), *arrow[u], int(n), f.mean, f.sd))
            for lo, hi in combinations(lines, 2):
                d = lines[hi][0] - lines[lo][0]
                out.append((*stratum, "contrast", f"{hi} - {lo}", float(d @ f.beta), float(np.sqrt(max(d @ cov @ d, 0.0))),
                            None, None, int(lines[hi][1] + lines[lo][1]), f.mean, f.sd))
        return pd.DataFrame(out, columns=[*by, "kind", "level", "estimate", "se", "lower", "upper", "n", "y_mean", "y_sd"])
    return _per_group(df, m, rows, types + "kind string, level string, estimate double, se double, lower double, upper double, "
                                           "n long, y_mean double, y_sd double")


def plotted_means(mm: DataFrame) -> DataFrame:
    """ST10 + ST11: the symmetric comparison bar of every mean (the longer arrow), and means, bars and contrasts in
    units of the response."""
    contrast = F.col("kind") == "contrast"
    out = comparison_bars(mm.withColumnRenamed("se", "se_model"), "estimate", "lower", "upper").withColumnRenamed("SE", "bar")
    out = unstandardise(out, {"estimate": "estimate_unscaled"}, F.col("y_mean"), F.col("y_sd"))
    return out.withColumns({
        "estimate_unscaled": F.when(contrast, F.col("estimate") * F.col("y_sd")).otherwise(F.col("estimate_unscaled")),
        "se_unscaled": F.col("se_model") * F.col("y_sd"), "bar_unscaled": F.col("bar") * F.col("y_sd")}).withColumnRenamed("se_model", "se")
