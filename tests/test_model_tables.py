"""Three-axis similarity and the closed-form centring constants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import features, similarity


def test_similarity_per_bin_holds_the_encoding_side_for_every_bin(spark):
    rng = np.random.default_rng(3)
    n_features, n_bins = 6, 3
    base = np.where(np.arange(20) % 2, 1.0, -1.0)[:, None, None] * np.ones((20, n_features, n_bins))  # means 0, sds 1
    enc, test = rng.normal(size=(2, n_features, n_bins)), rng.normal(size=(2, n_features, n_bins))
    test[1, :, 1] = 2.0  # a constant side

    def frame(x, kind):
        return spark.createDataFrame([(1, i, v.reshape(-1).tolist(), kind) for i, v in enumerate(x)], "s long, event long, features array<double>, kind string")
    mu, sd = base.mean(axis=(0, 2)), base.std(axis=(0, 2))
    z = {}
    for name, x in (("enc", enc), ("test", test)):
        z[name] = similarity.normalise_bins(frame(x, name), frame(base, "b"), ["s"], n_features, n_bins)
    a = z["enc"].select("s", F.col("event").alias("ea"), similarity.keep_bins("z_bins", 0, n_bins - 1, n_features).alias("u"))
    b = z["test"].select("s", F.col("event").alias("eb"), F.col("z_bins").alias("v"))
    got = {(r.ea, r.eb, r.bin): (r.corr, r.corr_z) for r in similarity.similarity_per_bin(a.join(b, "s"), "u", "v", "bin").collect()}
    assert len(got) == 2 * 2 * 3
    for i in range(2):
        u = ((enc[i].mean(axis=1)) - mu) / sd
        for j in range(2):
            for k in range(n_bins):
                v = (test[j, :, k] - mu) / sd
                if np.ptp(v) < 1e-9:
                    assert got[i, j, k] == (None, None)
                else:
                    r = np.corrcoef(u, v)[0, 1]
                    assert np.isclose(got[i, j, k][0], r) and np.isclose(got[i, j, k][1], np.arctanh(r))


def test_keep_bins_takes_its_window_and_skips_missing(spark):
    df = spark.createDataFrame([([[1.0, None], [3.0, None], [8.0, 4.0]],)], "z array<array<double>>")
    r = df.select(similarity.keep_bins("z", 0, 1, 2).alias("a"), similarity.keep_bins("z", 1, 2, 2).alias("b")).first()
    assert r.a == [2.0, None] and r.b == [5.5, 4.0]


@pytest.mark.parametrize("previous", [False, True])
def test_split_half_constants_match_the_pairs(spark, previous):
    sizes = [3, 6, 7, 8, 12, 20]
    ev = spark.createDataFrame([(k, p + 1) for k, n in enumerate(sizes) for p in range(n)], "list long, serialpos long")
    d = [t - e for n in sizes for t in range(7, n + (0 if previous else 1)) for e in range(1, 7)]
    r = spark.range(1).select(features.split_half_distance_constants(ev, ["list"], 6, previous).alias("s")).first().s
    assert np.isclose(r.m, np.mean(d)) and r.mx == max(d)


def test_paired_position_constants_match_the_pairs(spark):
    words = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 9)], "list long, serialpos long")
    other = spark.createDataFrame([(1,), (2,), (2,), (4,)], "list long")
    pairs = [1, 2, 1, 2, 3, 1, 2, 3]
    r = spark.range(1).select(features.paired_position_constants(words, other, ["list"], "serialpos").alias("s")).first().s
    assert np.isclose(r.m, np.mean(pairs)) and r.mx == 3
