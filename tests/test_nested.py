"""Effects at nested levels against plain fits of every unit's rows."""

import numpy as np
import pandas as pd
import pytest

from trialspark.operators import nested


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    n = 900
    pdf = pd.DataFrame({"a": rng.integers(0, 6, n), "b": rng.integers(0, 3, n), "c": rng.integers(0, 5, n), "x": rng.integers(0, 9, n).astype(float)})
    pdf["y"] = 1e4 + pdf.x * (1 + 0.3 * pdf.a) + rng.normal(size=n)
    pdf.loc[(pdf.a == 0) & (pdf.b == 0) & (pdf.c == 0), "x"] = 4.0  # a unit without variation
    pdf.loc[:3, "y"] = np.nan
    return pdf


def test_moments_of_every_level_are_those_of_its_rows(spark, rows):
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "a long, b long, c long, x double, y double").repartition(5)
    got = nested.level_moments(df, ["a", "b", "c"], "y", "x").toPandas()
    part = rows.dropna()
    for depth in range(4):
        keys = ["a", "b", "c"][:depth]
        groups = part.groupby(keys) if keys else [((), part)]
        own = got[got.depth == depth]
        assert len(own) == len(groups)
        for key, g in groups:
            r = own
            for k, v in zip(keys, key if isinstance(key, tuple) else (key,)):
                r = r[r[k] == v]
            assert r.n.item() == len(g)
            assert np.isclose(r.sxx.item(), ((g.x - g.x.mean()) ** 2).sum(), atol=1e-6)
            assert np.isclose(r.sxy.item(), ((g.x - g.x.mean()) * (g.y - g.y.mean())).sum(), atol=1e-4)


def test_slopes_shrink_toward_their_parents(spark, rows):
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "a long, b long, c long, x double, y double").repartition(5)
    got = nested.nested_effects(df, ["a", "b", "c"], "y", "x").toPandas()
    part = rows.dropna()
    assert got.groupby("level").size().to_dict() == {"a": 6, "b": 18, "c": 90}
    fit = lambda g: np.polyfit(g.x, g.y, 1)[0]
    whole = fit(part)
    for r in got[got.level == "a"].itertuples():
        own = fit(part[part.a == r.a])
        assert np.isclose(r.slope, own) and min(own, whole) - 1e-9 <= r.shrunk <= max(own, whole) + 1e-9
    by_session = {(r.a, r.b): r.slope for r in got[got.level == "b"].itertuples()}
    lists = got[got.level == "c"]
    flat = lists[(lists.a == 0) & (lists.b == 0) & (lists.c == 0)].iloc[0]
    assert np.isnan(flat.slope) and np.isclose(flat.shrunk, by_session[0, 0])
    # true slopes differ between subjects only: lists go nearly all the way to their session
    own = lists.dropna(subset=["slope"])
    far = np.abs(own.slope - [by_session[k] for k in zip(own.a, own.b)])
    left = np.abs(own.shrunk - [by_session[k] for k in zip(own.a, own.b)])
    assert left.sum() < 0.5 * far.sum() and (left <= far + 1e-9).all()
    assert nested.nested_effects(df.limit(0), ["a", "b"], "y", "x").count() == 0
