"""Array correlations against numpy (pairwise-complete), leave-one-frequency-out identity."""
import numpy as np

from trialspark.operators import similarity


def _pairs(spark, a, b):
    return spark.createDataFrame([(list(map(float, a)) if a is not None else None, list(map(float, b)))],
                                 "a array<double>, b array<double>")


def test_pearson_matches_numpy_with_missing(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=16), rng.normal(size=16)
    a_l = [None if i == 3 else float(v) for i, v in enumerate(a)]
    df = spark.createDataFrame([(a_l, [float(v) for v in b])], "a array<double>, b array<double>")
    r = similarity.pairwise_similarity(df, "a", "b").first()
    mask = np.arange(16) != 3
    assert abs(r.corr - np.corrcoef(a[mask], b[mask])[0, 1]) < 1e-12
    assert abs(r.corr_z - np.arctanh(r.corr)) < 1e-12


def test_constant_side_is_null(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    assert similarity.pairwise_similarity(df, "a", "b").first().corr is None


def test_leave_one_frequency_out_equals_direct(spark):
    rng = np.random.default_rng(1)
    n_ch, n_f = 4, 8
    a, b = rng.normal(size=n_ch * n_f), rng.normal(size=n_ch * n_f)
    df = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b])], "a array<double>, b array<double>")
    df = df.withColumns({"af": similarity.frequency_major("a", n_ch, n_f), "bf": similarity.frequency_major("b", n_ch, n_f)})
    rows = sorted(similarity.leave_one_frequency_out(df, "af", "bf", n_ch, n_f).collect(), key=lambda r: r.drop_freq)
    assert len(rows) == n_f
    for r in rows:
        keep = np.arange(n_ch * n_f) % n_f != r.drop_freq
        assert abs(r.corr - np.corrcoef(a[keep], b[keep])[0, 1]) < 1e-12


def test_baseline_normalisation(spark):
    ev = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 2.0]), (1, 2, [5.0, 6.0])],
                               "session int, event int, features array<double>")
    base = ev.where("event < 2")
    z = similarity.normalise_to_baseline(ev.where("event = 2"), base, ["session"]).first().z
    assert z[0] == (5.0 - 2.0) / 1.0 and z[1] is None      # sd 0 -> NULL (R9)


def test_undefined_correlations_are_null(spark):
    for c in (0.1, 1 / 3, 2.7, 0.0):
        vary = [float(v) for v in np.random.default_rng(1).normal(size=64)]
        df = spark.createDataFrame([([c] * 64, vary), ([None] * 64, vary)], "a array<double>, b array<double>")
        fm = df.select(similarity.frequency_major("a", 8, 8).alias("a"), similarity.frequency_major("b", 8, 8).alias("b"),
                       similarity.channel_means("a", 8, 8).alias("m"))
        assert [(r.corr, r.corr_z) for r in similarity.pairwise_similarity(df, "a", "b").collect()] == [(None, None)] * 2
        assert {(r.corr, r.corr_z) for r in similarity.leave_one_frequency_out(fm, "a", "b", 8, 8).collect()} == {(None, None)}
        assert [r.corr_z for r in similarity.similarity_over_time(fm, "m", "b", 8, 8).collect()] == [None] * 2


def test_correlation_far_from_zero_keeps_its_digits(spark):
    rng = np.random.default_rng(2)
    a, b = 1e8 + rng.normal(size=64), 1e8 + rng.normal(size=64)
    want = np.corrcoef(a, b)[0, 1]
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    assert abs(similarity.pairwise_similarity(df, "a", "b").first().corr - want) < 1e-7
    fm = df.select(similarity.frequency_major("a", 8, 8).alias("a"), similarity.frequency_major("b", 8, 8).alias("b"))
    drop = {r.drop_freq: r.corr for r in similarity.leave_one_frequency_out(fm, "a", "b", 8, 8).collect()}
    for f in range(8):
        keep = [i for i in range(64) if i % 8 != f]
        assert abs(drop[f] - np.corrcoef(a[keep], b[keep])[0, 1]) < 1e-6


def test_similarity_symmetric_and_bounded(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        a = rng.normal(size=32)
        b = 0.3 * a + rng.normal(size=32)
        a_l = [None if rng.random() < 0.1 else float(v) for v in a]
        rows.append((i, a_l, [float(v) for v in b]))
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    out = df.select("id", similarity.pearson("a", "b").alias("ab"), similarity.pearson("b", "a").alias("ba")).collect()
    for r in out:
        assert r.ab is not None and abs(r.ab - r.ba) < 1e-12 and -1.0 <= r.ab <= 1.0
    assert df.select(F.count("*")).first()[0] == 60
