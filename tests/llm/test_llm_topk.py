import math

import numpy as np
import pytest
from corpus_fixture import collect
from pyspark.sql import functions as F

from trialspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, node long, rank int, dim string, list int"


def brute(rows, k=5):
    """Every query row against every other row; a row repeated with its id counts once."""
    ok = []
    for i, e in rows:
        if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e):
            r = (i, tuple(math.floor(256 * float(np.float32(c))) for c in e))
            if r not in ok:
                ok.append(r)
    out = []
    for i, x in ok:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in ok if (j, y) != (i, x) and len(x) == len(y))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def search(spark, rows, k=5, **more):
    df = spark.createDataFrame([(i, e, 1, "a", 2, 3, "b", 4) for i, e in rows], SCHEMA).repartition(4)
    return sorted(tuple(r.values()) for r in collect(topk.top_k(df, F.col("vec_id") % 50 == 0, k, **more)))


@pytest.mark.parametrize("lists, query_block, row_block", [(2, 4096, 4096), (3, 4, 100), (1, 7, 50)])
def test_matches_every_product(spark, lists, query_block, row_block):
    rng = np.random.default_rng(lists)
    rows = [(i, (rng.normal(size=10) + (i % 3)).tolist()) for i in range(600)]
    assert search(spark, rows, lists=lists, query_block=query_block, row_block=row_block) == brute(rows)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    hot, other = rng.normal(size=8).tolist(), rng.normal(size=8).tolist()
    rows = [(i, hot) for i in range(0, 300, 3)] + [(i, rng.integers(-1, 2, size=8).astype(float).tolist()) for i in range(1, 300, 3)]
    rows += [(i, [0.0] * 8) for i in range(2, 300, 3)] + [(1000, other), (1000, hot), (1000, hot), (1050, [1.0] + [0.0] * 7)]
    assert search(spark, rows) == brute(rows)


def test_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [3.0, -1.0]), (1, [0.5, 0.5]), (None, [9.0, 9.0]), (2, None), (100, None), (3, [nan, 1.0]),
            (150, [inf, 1.0]), (4, [None, 1.0]), (200, []), (5, []), (250, [7.0]), (300, [1.0, 2.0, 3.0]), (6, [-1.0, 0.0, 2.0]), (0, [1.0, 2.0])]
    assert search(spark, rows) == brute(rows)  # fewer rows than k; lengths 0, 1, 2 and 3 apart
    assert search(spark, []) == [] and search(spark, [(1, [1.0])]) == []
    huge = search(spark, [(0, [3e38, 1.0]), (50, [-3e38, 1.0]), (1, [1.0, 1.0])])
    assert [(q, r, v) for q, r, v, _ in huge] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]


def test_only_entries_over_the_uniform_threshold_are_collected(spark):
    """Phase 2 sends a small part of all partial scores, and phase 3 asks only for those pairs."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(2000, 64)) / 8).astype(int).tolist()
    nodes = spark.createDataFrame([(i, i, 64, v) for i, v in enumerate(x)], "node long, low long, dim int, x array<bigint>").cache()
    queries = nodes.where("node % 50 = 0")
    held = topk.Lists(nodes, queries, 2, 4096, 512)
    assert held.gather(6, 6).groupBy("q", "list").count().where("count <> 6").isEmpty()
    first = held.gather(6, 20)
    cut = topk._best(held.resolve(first), 6).where("place = 6").select("q", F.col("score").alias("cut"), F.col("low").alias("cut_low"))
    entries = held.collect(cut).cache()
    assert entries.count() < 0.05 * 40 * 2000 * 2
    got = {(r.q, r.c): r.score for r in topk._best(held.resolve(entries, cut), 6).collect()}
    m = np.array(x)
    for q in range(0, 2000, 50):
        s = m @ m[q]
        assert {c for a, c in got if a == q} == set(sorted(range(2000), key=lambda c: (-s[c], c))[:6])
        assert all(v == s[c] for (a, c), v in got.items() if a == q)
