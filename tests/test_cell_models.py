"""Cell models against plain least squares over the rows."""

import numpy as np
import pandas as pd
import pytest

from trialspark.operators import cell_models as cm


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 600
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.4
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "a": a, "inner": a & (rng.random(n) < 0.5), "b": b,
                        "f": rng.integers(1, 5, n), "v": rng.normal(size=n), "w": rng.normal(size=n)})
    pdf["y"] = 100 + pdf.a * 1.5 + pdf.inner - pdf.b * pdf.v + pdf.f * 0.3 + rng.normal(size=n)
    pdf.loc[:4, "y"] = np.nan
    pdf.loc[5:7, "v"] = None
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                      "g long, a boolean, inner boolean, b boolean, f long, v double, w double, y double")


def ols(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = ((y - x @ beta) ** 2).sum()
    dof = len(y) - np.linalg.matrix_rank(x)
    return beta, rss, dof, rss / dof * np.linalg.pinv(x.T @ x)


def test_formulas():
    assert cm.formula_terms("a * b") == [(), ("a",), ("b",), ("a", "b")]
    assert cm.formula_terms("(a + b + c)^2 - a:c") == [(), ("a",), ("b",), ("c",), ("a", "b"), ("b", "c")]
    assert cm.formula_terms("(a + b) * c * d - a:c:d + e + d:e")[-1] == ("b", "c", "d")
    assert cm.formula_terms("a:b:c + a") == [(), ("a",), ("a", "b", "c")]
    assert cm.formula_terms([(), ("a",)]) == [(), ("a",)]


def test_coefficients_with_covariates_and_keys(rows):
    pdf, df = rows
    m = cm.model(df, "y", "a * v + b + v:b + w", keys=["g"])
    got = cm.coefficients(df, m).toPandas()
    for g, part in pdf.dropna(subset=["y", "v"]).groupby("g"):
        d = {"(Intercept)": 1.0, "a": part.a, "v": part.v, "b": part.b, "w": part.w, "a:v": part.a * part.v, "v:b": part.b * part.v}
        x = np.stack([np.broadcast_to(np.asarray(c, float), len(part)) for c in d.values()], axis=1)
        beta, rss, dof, cov = ols(x, ((part.y - part.y.mean()) / part.y.std()).to_numpy())
        own = got[got.g == g].set_index("term").loc[list(d)]
        assert np.allclose(own.estimate, beta) and np.allclose(own.se, np.sqrt(np.diag(cov)))


def test_type3_of_whole_blocks(rows):
    """A factor of four levels has three degrees of freedom; blocks are tested against all others, sum-coded."""
    pdf, df = rows
    got = cm.type3_tests(df, cm.model(df, "y", "a * f + v", factors=["f"], standardise=False)).toPandas().set_index("term")
    part = pdf.dropna(subset=["y", "v"])
    one = {"a": np.where(part.a, -1.0, 1.0)[:, None],
           "f": np.stack([(part.f == k).astype(float) - (part.f == 4) for k in (1, 2, 3)], axis=1), "v": part[["v"]].to_numpy()}
    one["a:f"] = one["a"] * one["f"]
    full = np.concatenate([np.ones((len(part), 1)), *one.values()], axis=1)
    _, rss, dof, _ = ols(full, part.y.to_numpy())
    for t in one:
        less = np.concatenate([np.ones((len(part), 1)), *[c for u, c in one.items() if u != t]], axis=1)
        q = one[t].shape[1]
        f = (ols(less, part.y.to_numpy())[1] - rss) / q / (rss / dof)
        assert (got.num_df[t], got.den_df[t]) == (q, dof) and abs(got.f[t] - f) < 1e-6 * (1 + f)
    assert got.num_df["f"] == got.num_df["a:f"] == 3


def test_marginal_means_with_a_nested_factor(rows):
    """inner is nested in a: the grid has three cells a stratum; means share coefficients, so a contrast's error
    is not the root of the two errors' squares."""
    pdf, df = rows
    got = cm.marginal_means(df, cm.model(df, "y", "inner + a + b + v", standardise=False), "a", ["b"]).toPandas()
    part = pdf.dropna(subset=["y", "v"])
    x = np.stack([np.ones(len(part)), part.inner, part.a, part.b, part.v], axis=1).astype(float)
    beta, _, _, cov = ols(x, part.y.to_numpy())
    x[:, 4] = x[:, 4].mean()
    for b in (False, True):
        line = {u: x[(part.a == u) & (part.b == b)].mean(axis=0) for u in (False, True)}
        own = got[got.b == b].set_index("level")
        for u, l in line.items():
            assert np.isclose(own.estimate[str(u)], l @ beta) and np.isclose(own.se[str(u)], np.sqrt(l @ cov @ l))
        d = line[True] - line[False]
        se = np.sqrt(d @ cov @ d)
        assert np.isclose(own.estimate["True - False"], d @ beta) and np.isclose(own.se["True - False"], se)
        assert not np.isclose(se, np.hypot(own.se["True"], own.se["False"]), rtol=1e-3)
        # arrows point at each other only, and overlap exactly when the difference is not significant
        assert np.isclose(own.upper["False"] - own.estimate["False"], cm.Z_95 * se / 2) and np.isnan(own.lower["False"])
        assert np.isclose(own.estimate["True"] - own.lower["True"], cm.Z_95 * se / 2) and np.isnan(own.upper["True"])


def test_dependent_columns_and_hard_tables(spark, rows):
    pdf, df = rows
    twice = df.withColumn("a2", df.a)
    got = cm.coefficients(twice, cm.model(twice, "y", "a + a2 + b")).toPandas().set_index("term")
    assert np.isnan(got.estimate["a2"]) and not np.isnan(got.estimate["b"])
    assert cm.coefficients(df.limit(0), cm.model(df, "y", "a")).count() == 0
    one = df.where("y is not null").limit(1)
    assert cm.coefficients(one, cm.model(one, "y", "a")).count() >= 1
    with pytest.raises(ValueError):
        cm.model(df, "y", "a * nothing")
    with pytest.raises(ValueError):
        cm.model(df, "y", "v:w")
