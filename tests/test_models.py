"""Model registry: lookup, validation, and the OLS fit against numpy."""
import numpy as np
import pytest

from trialspark.operators import models


def test_lookup_by_name_and_ordinal():
    assert models.model_formula("FR1", "encoding_isi", 0)[0] == "m1"
    name, f = models.model_formula("catFR1", "encoding", "m1_final")
    assert name == "m1_final" and "abs_serialpos_dist_scale" in f


def test_fit_matches_numpy(spark):
    rng = np.random.default_rng(6)
    n = 400
    sc = rng.integers(0, 2, n).astype(bool)
    d = rng.normal(size=n)
    y = 0.3 * sc + 0.2 * d - 0.1 * sc * d + rng.normal(size=n) * 0.5
    df = spark.createDataFrame([(bool(a), float(b), float(c)) for a, b, c in zip(sc, d, y)],
                               "same_category boolean, abs_serialpos_dist_scale double, corr_z double")
    got = {r.term: r.estimate for r in models.fit_registry_model(df, "catFR1", "encoding", "m1_final").collect()}
    ys = (y - y.mean()) / y.std(ddof=1)
    X = np.c_[np.ones(n), sc, d, sc * d]
    beta = np.linalg.lstsq(X, ys, rcond=None)[0]
    assert abs(got["(Intercept)"] - beta[0]) < 1e-8
    assert abs(got["same_category:abs_serialpos_dist_scale"] - beta[3]) < 1e-8


def test_missing_column_is_an_error(spark):
    df = spark.createDataFrame([(1.0,)], "corr_z double")
    with pytest.raises(ValueError):
        models.fit_registry_model(df, "catFR1", "encoding", "m1")
