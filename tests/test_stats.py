"""Statistics operators against numpy."""
import numpy as np
from pyspark.sql import functions as F

from trialspark.operators import stats, summaries


def test_per_group_effects_and_singular(spark):
    rng = np.random.default_rng(2)
    rows = [("g1", float(x), 2.0 + 0.5 * x + rng.normal() * 0.1) for x in range(10)]
    rows += [("g2", 1.0, 3.0), ("g2", 1.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in stats.per_group_effects(df, ["g"], "y", ["x"]).collect()}
    xs = np.arange(10.0)
    ys = np.array([r[2] for r in rows[:10]])
    b1, b0 = np.polyfit(xs, ys, 1)
    assert abs(got["g1"].b_x - b1) < 1e-9 and abs(got["g1"].b_intercept - b0) < 1e-9
    assert got["g2"].b_x is None and got["g2"].reason == "singular design"


def test_variance_parts_add_up(spark):
    rng = np.random.default_rng(3)
    rows = [(s, se, l, float(rng.normal())) for s in range(3) for se in range(2) for l in range(3) for _ in range(4)]
    df = spark.createDataFrame(rows, "subject int, session int, list int, y double")
    parts = {r.level: r.ss for r in stats.variance_by_level(df, "y", ["subject", "session", "list"]).collect()}
    y = np.array([r[3] for r in rows])
    assert abs(sum(parts.values()) - ((y - y.mean()) ** 2).sum()) < 1e-9


def test_fixed_effects_saturated_equals_cell_means(spark):
    rows = [(a, b, float(a * 2 + b + (i % 3))) for a in (0, 1) for b in (0, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "a int, b int, y double")
    res = {r.term: r.estimate for r in stats.fit_fixed_effects(df, "y", stats.expand_interactions(["a", "b"])).collect()}
    assert abs(res["(Intercept)"] - 1.0) < 1e-9 and abs(res["a"] - 2.0) < 1e-9 and abs(res["b"] - 1.0) < 1e-9
    assert stats.type3_tests(df, "y", stats.expand_interactions(["a", "b"])).count() == 3


def test_within_subject_summary_keeps_grand_mean(spark):
    rng = np.random.default_rng(4)
    rows = [(s, 1, l, c, float(rng.normal() + c)) for s in range(4) for l in range(3) for c in (0, 1) for _ in range(2)]
    df = spark.createDataFrame(rows, "subject int, session int, list int, cond int, v double")
    out = summaries.within_subject_summary(df, "v", "subject", "session", "list", ["cond"])
    got = {r.cond: r for r in out.collect()}
    assert got[0].n_subjects == 4 and got[1].mean_value > got[0].mean_value
    # Cousineau adjustment keeps the grand mean (balanced design)
    grand = df.agg(F.avg("v")).first()[0]
    assert abs((got[0].mean_value + got[1].mean_value) / 2 - grand) < 1e-9


def test_nested_means_rows_and_unit(spark):
    from trialspark.operators import ordered
    rows = [(1, 1, 1, 1.0), (1, 1, 1, 3.0), (1, 1, 2, 5.0), (1, 2, 1, 7.0), (2, 1, 1, 10.0)]
    df = spark.createDataFrame(rows, "subject int, session int, list int, v double")
    got = {tuple(r[:4]): r for r in summaries.add_nested_means(df, "v", ["subject", "session", "list"]).collect()}
    r = got[(1, 1, 1, 1.0)]
    assert r.v_list_mean == 2.0 and abs(r.v_sess_mean - 3.0) < 1e-12 and abs(r.v_sub_mean - 4.0) < 1e-12
    assert abs(r.v_all_mean - 5.2) < 1e-12 and abs(r.v_list_adj - (1.0 - 2.0 + 5.2)) < 1e-12
    u = {tuple(x[:4]): x for x in summaries.add_nested_means(df, "v", ["subject", "session", "list"],
                                                             weighting="unit").collect()}
    assert abs(u[(1, 1, 1, 1.0)].v_sess_mean - 3.5) < 1e-12      # mean of list means 2 and 5
    d = {r.list: r.n for r in ordered.group_distinct_count(df, ["subject", "session"], "list", "n").collect()
         if r.subject == 1 and r.session == 1}
    assert d == {1: 2, 2: 2}


def test_in_pass_standardisation_equals_two_pass(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(b), float(50 + 10 * a + 3 * b + rng.normal() * 5)) for a, b in
            zip(rng.integers(0, 2, 300), rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "a int, b int, y double")
    terms = stats.expand_interactions(["a", "b"])
    one = {r.term: (r.estimate, r.se) for r in stats.fit_fixed_effects(df, "y", terms, standardise=True).collect()}
    two = {r.term: (r.estimate, r.se) for r in
           stats.fit_fixed_effects(stats.standardise(df, "y", "z"), "z", terms).collect()}
    for k in one:
        assert abs(one[k][0] - two[k][0]) < 1e-9 and abs(one[k][1] - two[k][1]) < 1e-9
    v1 = {r.level: r.ss for r in stats.variance_by_level(df.withColumn("g", F.lit(1)).withColumn("l", F.col("a")),
                                                         "y", ["g", "l"], standardise=True).collect()}
    assert abs(sum(v1.values()) - (len(rows) - 1)) < 1e-6


def test_closed_form_distance_constants(spark):
    from trialspark.operators import features
    sizes = [1, 2, 5, 7]
    rows = [(li, p) for li, n in enumerate(sizes) for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "list int, serialpos int")
    st = spark.range(1).select(features.later_position_distance_constants(df, ["list"]).alias("st")).first().st
    d = [t - e for n in sizes for e in range(1, n + 1) for t in range(e + 1, n + 1)]
    assert abs(st.m - sum(d) / len(d)) < 1e-12 and st.mx == max(d)


def test_type3_leaves_numeric_covariates_unshifted(spark):
    rng = np.random.default_rng(11)
    a = rng.integers(0, 2, 200).astype(float)
    x = rng.normal(3.0, 2.0, 200)
    y = 0.4 * a + 0.7 * x + 0.5 * a * x + rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, x, y)], "a double, x double, y double")
    got = {r.term: r.f for r in stats.type3_tests(df, "y", [(), ("a",), ("x",), ("a", "x")], covariates=["x"]).collect()}
    s = a - 0.5
    full = np.column_stack([np.ones(200), s, x, s * x])

    def rss(m):
        return float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    for name, drop in (("a", 1), ("x", 2), ("a:x", 3)):
        want = (rss(np.delete(full, drop, axis=1)) - rss(full)) / (rss(full) / 196)
        assert abs(got[name] - want) < 1e-6 * max(1.0, want)
