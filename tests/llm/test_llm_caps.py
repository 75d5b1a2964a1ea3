import numpy as np
import pytest
from corpus_fixture import classes, collect

from trialspark.llm import caps

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node long, key long"


def brute(rows, cosine=0.9):
    ok = {}
    for vec_id, e, *_ in rows:
        if vec_id is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            ok[vec_id] = np.array(e, dtype=np.float32).astype(float)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine]
    ids = [r[0] for r in rows if r[0] is not None]
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return links, n, classes(ids, links)


def vectors(rng, clusters, each, spread, dim=64):
    rows, i = [], 0
    for _ in range(clusters):
        c = rng.normal(size=dim)
        for _ in range(each):
            rows.append((i, (c + rng.normal(size=dim) * spread).astype(np.float32).tolist(), i % 7))
            i += 1
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    return {r["vec_id"]: r for r in collect(caps.near_vectors(df, **more))}


def test_links_match_brute_force_well_above_the_threshold(spark):
    rows = vectors(np.random.default_rng(1), 60, 5, 0.15)
    _, n, component = brute(rows)
    got = run(spark, rows)
    assert {i: r["n_links"] for i, r in got.items()} == n
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_recall_of_links_around_the_threshold(spark):
    rows = vectors(np.random.default_rng(2), 150, 4, 0.3)  # cosines about 0.92
    links, n, _ = brute(rows)
    got = run(spark, rows)
    assert len(links) > 300
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * 2 * len(links)
    assert all(r["n_links"] <= n[i] for i, r in got.items())


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 5, 8, 12, 16, 64, 384])
def test_pairs_share_a_filter_at_any_length(dim):
    rng = np.random.default_rng(dim)
    f = caps.filters(dim, caps.CODE, caps.REPEATS, caps.PASSES, 0.9)
    x = rng.normal(size=(400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=(400, dim))
    g -= (g * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * g / np.linalg.norm(g, axis=1, keepdims=True) if dim > 1 else 2 * x / 2
    found = []
    for v in (x, y):
        row, key = f.decode(v)
        assert np.bincount(row, minlength=400).max() < 1000
        found.append([set(key[row == i].tolist()) for i in range(400)])
    assert sum(bool(a & b) for a, b in zip(*found)) >= 0.97 * 400


@pytest.mark.parametrize("dim", [1, 2, 3, 8])
def test_links_of_short_vectors(spark, dim):
    rows = [(i, rng_v.tolist(), 0) for i, rng_v in enumerate(np.random.default_rng(dim + 50).normal(size=(150, dim)).astype(np.float32))]
    links, n, _ = brute(rows)
    got = run(spark, rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * 2 * len(links)
    assert all(r["n_links"] <= n[i] for i, r in got.items())


def test_large_group_is_cut_into_tiles(spark):
    rows = vectors(np.random.default_rng(3), 1, 120, 0.1) + [(1000 + i, v, 0) for i, v, _ in vectors(np.random.default_rng(4), 10, 1, 1)]
    _, n, component = brute(rows)
    got = run(spark, rows, tile=25)
    assert {i: r["n_links"] for i, r in got.items()} == n
    assert {i: r["component_id"] for i, r in got.items()} == component


def test_hard_cases(spark):
    v = vectors(np.random.default_rng(5), 1, 2, 0.05)
    a, b = v[0][1], v[1][1]
    rows = [(1, a, 0), (2, b, 1), (3, a, None), (4, None, 0), (5, [0.0] * 64, 0), (6, [float("nan")] + a[1:], 0),
            (7, [None] + a[1:], 0), (8, [float("inf")] + a[1:], 0), (9, [], 0), (None, a, 0), (3, a, None),
            (10, [1.0, 2.0], 0), (11, [2.0, 4.0], 0), (12, [1.0], 0), (13, [3.0], 0), (14, [-1.0], 0),
            (15, [x * 2 for x in a], 0)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    out = collect(caps.near_vectors(df))
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert got[1] == got[2] == got[3] == got[15] == (3, 1)
    assert all(got[i] == (0, i) for i in (4, 5, 6, 7, 8, 9, 14))
    assert got[10] == got[11] == (1, 10) and got[12] == got[13] == (1, 12)
    assert got[None] == (0, None)
    assert collect(caps.near_vectors(df.limit(0))) == []
