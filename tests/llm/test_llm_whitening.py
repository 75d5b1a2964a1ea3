import math

import numpy as np
from corpus_fixture import collect

from trialspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component long, dim string, x long"


def brute(rows, wanted=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by numpy's eigensolver, and the covariance."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in e]) for i, e in rows
            if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=float)
    n, s = len(x), [int(c) for c in x.sum(axis=0)]
    c = x - x.mean(axis=0)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    out = {}
    for i, w in kept:
        z = (np.array(w) - x.mean(axis=0)) @ u / np.sqrt(e)
        for k in range(len(e)):
            out[i, k + 1] = (n, sum((n * a - b) ** 2 for a, b in zip(w, s)), abs(z[k]), e[k] / np.trace(v))
    return out


def whiten(spark, rows, **more):
    df = spark.createDataFrame([(i, e, 1, "a", 2, "b", 3) for i, e in rows], SCHEMA).repartition(4)
    return collect(whitening.whiten(df, **more))


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        n, deviation, size, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - size) <= 1e-7 * (1 + size)
        assert abs(r["explained"] - explained) <= 1e-9
        assert r["identity_error"] < 1e-9


def test_matches_a_dense_eigensolver(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(24, 24)) * np.linspace(2, 0.1, 24)
    rows = [(i, (rng.normal(size=24) @ mix + 3).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies count once
    got = whiten(spark, rows)
    compare(got, brute(rows))
    sign = {}
    for r in got:  # one sign for all rows: copies agree, and the mean over distinct vectors is zero
        if r["vec_id"] >= 1000 or r["vec_id"] == 0:
            sign.setdefault(r["component"], set()).add(r["whitened"])
    assert all(len(v) == 1 for v in sign.values())


def test_far_from_the_origin_and_exact_longs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) + 4e4).astype(np.float32).tolist()) for i in range(200)]
    compare(whiten(spark, rows), brute(rows))


def test_hard_cases(spark):
    rng = np.random.default_rng(3)
    sound = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, [])]
    again = [(None, sound[0][1]), (0, sound[0][1])]
    got = whiten(spark, sound + bad + again)
    assert {r["vec_id"] for r in got} == {None, *range(40)} and len(got) == 42 * 3
    assert {r["component"] for r in got} == {1, 2, 3}
    compare([r for r in got if r["vec_id"] not in (None, 0)], {k: v for k, v in brute(sound).items() if k[0] != 0})
    # one distinct vector, or none: no component has variance
    assert whiten(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert whiten(spark, bad) == []
    # components without variance are left out; huge entries do not crash
    line = whiten(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    huge = whiten(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.5])])
    assert huge and all(np.isfinite(r["whitened"]) for r in huge)
    # lengths have fits of their own
    two = whiten(spark, sound + [(200 + i, rng.normal(size=2).tolist()) for i in range(30)])
    assert {r["n"] for r in two if r["vec_id"] < 100} == {40} and {r["n"] for r in two if r["vec_id"] >= 200} == {30}


def test_inertia_counts_and_interval():
    rng = np.random.default_rng(4)
    for d in (1, 2, 7, 40):
        m = rng.normal(size=(d, d))
        v = m @ m.T
        e = np.linalg.eigvalsh(v)
        tri = whitening.tridiagonal(v)
        for s in rng.uniform(e[0] - 1, e[-1] + 1, 25):
            assert whitening.count_above(tri, s) == (e > s).sum()
        low, high, count = whitening.interval(tri, e[-1] * 1.1, min(4, d))
        assert count == (e > low).sum() >= min(4, d) and high > e[-1]


def test_contour_finds_close_and_equal_eigenvalues(spark):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(50, 50)))[0]
    for top in ([5, 5, 5, 5, 5, 5, 5], [5, 4.999999, 4.99, 4.98999], [5, 3, 1, 1]):
        e = np.sort(np.concatenate([top, rng.uniform(0, 0.99, 50 - len(top))]))[::-1]
        v = (q * e) @ q.T
        values, vectors = whitening.leading(spark, (v + v.T) / 2, 4)
        assert np.allclose(values, e[:4], atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
        assert np.linalg.norm(v @ vectors - vectors * values) < 1e-11


def test_projection_is_the_spectral_projector(spark):
    """Without the contour's solves the space would not contain the interval's eigenvectors."""
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    e = np.array([9, 8, 7.5, *np.linspace(0, 3, 17)])
    v = (q * e) @ q.T
    y = rng.normal(size=(20, 5))
    got = whitening.project(spark, spark.sparkContext.broadcast(v), y, 6.0, 10.0, 32)
    assert np.allclose(got, q[:, :3] @ (q[:, :3].T @ y), atol=1e-6)
