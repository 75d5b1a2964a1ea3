"""Feature normalisation and pairwise similarity.

Data layout: one row per event with its feature vector as ``ARRAY<DOUBLE>``
ordered by the stacked (channel, frequency) axis, element k = (channel
k div n_freqs, frequency k mod n_freqs). Missing features are NULL elements.

Plan shape at scale:

* Baseline statistics (A11) explode the baseline vectors (a generator inside the
  scan stage) and reduce them with a partial aggregation on (session, feature):
  a hot session is split across map tasks before the shuffle. The result is
  one row per session holding K means and K standard deviations - bounded by
  the feature count, not by the data.
* Normalisation (T8/T9) is an equi-join of events to that per-session row;
  Spark picks broadcast or a shuffle join from the measured size (AQE), never
  a forced broadcast of something that grows with the data.
* Pairs (J9) are an equi-join on the list keys plus the position predicate
  (P20) in the join condition, so only within-list pairs are ever produced -
  the list length is fixed by the experiment design (12 or 27 items), so the
  pair count per list is bounded. The whole-session product is never formed.
* Correlations (A14) are computed inside the joined row with higher-order
  functions over the two arrays (pairwise-complete, R11): no explode of pairs
  into (pair, feature) rows and no second shuffle for the aggregation.
* Leave-one-frequency-out (T12) computes per-frequency partial moments of the
  centred features once per pair and derives all drop-one correlations from
  total - part, in the same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.nulls import fisher_z

FEATURES = "features"


# ---------------------------------------------------------------------------
# statistics and normalisation
# ---------------------------------------------------------------------------

def feature_stats(events: DataFrame, keys: Sequence[str], features: str = FEATURES,
                  time_col: str | None = None) -> DataFrame:
    """Mean and population sd (ddof=0) of each feature over the events (and time bins
    if ``time_col`` is given, as the reference pools event and time) per ``keys``.

    Returns one row per key combination with arrays ``mu`` and ``sd`` indexed like the features.
    """
    keys = list(keys)
    long = events.select(*keys, F.posexplode(features).alias("k", "x"))
    per = long.groupBy(*keys, "k").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    packed = per.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("k", "mu", "sd"))).alias("_st"))
    return packed.select(*keys, F.col("_st.mu").alias("mu"), F.col("_st.sd").alias("sd"))


def _zscore(x: Column, mu: Column, sd: Column) -> Column:
    centred = F.zip_with(x, mu, lambda v, m: v - m)
    return F.zip_with(centred, sd, lambda d, s: F.try_divide(d, s))


def normalise_to_baseline(events: DataFrame, baseline: DataFrame, keys: Sequence[str],
                          features: str = FEATURES, out: str = "z",
                          layout: tuple[int, int] | None = None) -> DataFrame:
    """(x - mean_baseline) / sd_baseline per session and feature; sd = 0 gives NULL.
    Events of a session without baseline get a NULL vector.

    With ``layout=(n_channels, n_freqs)`` two derived per-event arrays are added:
    ``<out>_fm`` (the z vector in frequency-major order) and ``<out>_mean`` (per-channel
    mean over frequencies). They are built element-wise from the join's output columns
    (features, mu, sd), so no array expression is re-evaluated inside a lambda; columns a
    query does not use are pruned.
    """
    st = feature_stats(baseline, keys, features)
    j = events.join(st, list(keys), "left")
    x, mu, sd = F.col(features), F.col("mu"), F.col("sd")
    cols = {out: _zscore(x, mu, sd)}
    if layout is not None:
        n_ch, n_f = layout

        def z_at(i):
            return F.try_divide(x[i] - mu[i], sd[i])
        cols[f"{out}_fm"] = F.transform(
            F.sequence(F.lit(0), F.lit(n_ch * n_f - 1)),
            lambda j_: z_at((j_ % n_ch) * n_f + F.floor(j_ / n_ch).cast("int")))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        cols[f"{out}_mean"] = F.transform(
            F.sequence(F.lit(0), F.lit(n_ch - 1)),
            lambda c: F.aggregate(
                F.sequence(F.lit(0), F.lit(n_f - 1)), zero,
                lambda acc, f: F.when(z_at(c * n_f + f).isNull(), acc).otherwise(F.struct(
                    (acc["s"] + z_at(c * n_f + f)).alias("s"), (acc["n"] + 1).alias("n"))),
                lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"])))
    return j.withColumns(cols).drop("mu", "sd")


def normalise_to_self(events: DataFrame, keys: Sequence[str], features: str = FEATURES,
                      out: str = "z", layout: tuple[int, int] | None = None) -> DataFrame:
    """The same with the events' own mean and sd (ddof=0)."""
    return normalise_to_baseline(events, events, keys, features, out, layout)


# ---------------------------------------------------------------------------
# pair space
# ---------------------------------------------------------------------------

def suffix(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename every column c to c_<name> (except ``keep``)."""
    return df.select(*[F.col(c).alias(c if c in keep else f"{c}_{name}") for c in df.columns])


def within_list_pairs(enc: DataFrame, test: DataFrame, list_keys: Sequence[str],
                      enc_period: str = "encoding", test_period: str = "encoding2",
                      condition: Column | None = None) -> DataFrame:
    """J9 + P19: equi-join of encoding and test events on the list keys, with an optional
    theta ``condition`` (P20) over the suffixed columns placed in the join condition."""
    a = suffix(enc, enc_period)
    b = suffix(test, test_period)
    cond = [a[f"{k}_{enc_period}"] == b[f"{k}_{test_period}"] for k in list_keys]
    if condition is not None:
        cond.append(condition)
    return a.join(b, cond, "inner")


def position_rule(test_period: str, enc_period: str = "encoding", list_len: int = 12,
                  test_prefix: str = "") -> Column:
    """P20: encoding vs encoding -> later test position; isi/end -> test position in the
    second half of the list and encoding position in the first half."""
    tp = F.col(f"{test_prefix}serialpos_{test_period}")
    ep = F.col(f"serialpos_{enc_period}")
    if test_period.startswith("encoding_isi") or test_period.startswith("encoding_end"):
        half = list_len // 2
        return (tp >= half + 1) & (ep <= half)
    return tp > ep


# ---------------------------------------------------------------------------
# correlations on arrays
#
# Each expensive array expression is materialised once as its own column
# (``_p``, ``_m``, ...); lambdas only reference their own variables, so an
# element-wise function never re-evaluates a whole-array expression, and
# Catalyst does not re-inline a non-cheap column that is referenced twice.
# Moments are single-pass sums (n, sx, sy, sxx, syy, sxy); features are
# z-scores shifted by their first element.
# ---------------------------------------------------------------------------

_MOMENT_FIELDS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _complete_pairs(a: Column, b: Column) -> Column:
    """(x, y) entries where both sides are present."""
    zipped = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.filter(zipped, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _moments(entries: Column, finish=None) -> Column:
    """Moment sums of (x, y) entries, both sides shifted by the first entry (x0, y0): a constant
    side has sums of exactly zero, and values far from zero keep their digits. ``finish`` maps the
    accumulator (a lambda variable) to the result inside the same expression."""
    zero = F.struct(*[F.lit(v).alias(n) for v, n in
                      [(0, "n"), (0.0, "sx"), (0.0, "sy"), (0.0, "sxx"), (0.0, "syy"), (0.0, "sxy"),
                       (0.0, "x0"), (0.0, "y0")]])

    def merge(s, q):
        first = s["n"] == 0
        x0, y0 = F.when(first, q["x"]).otherwise(s["x0"]), F.when(first, q["y"]).otherwise(s["y0"])
        dx, dy = F.when(first, 0.0).otherwise(q["x"] - s["x0"]), F.when(first, 0.0).otherwise(q["y"] - s["y0"])
        return F.struct(
            (s["n"] + 1).alias("n"), (s["sx"] + dx).alias("sx"), (s["sy"] + dy).alias("sy"),
            (s["sxx"] + dx * dx).alias("sxx"), (s["syy"] + dy * dy).alias("syy"),
            (s["sxy"] + dx * dy).alias("sxy"), x0.alias("x0"), y0.alias("y0"))
    return F.aggregate(entries, zero, merge, finish) if finish else F.aggregate(entries, zero, merge)


def _plain_moments(entries: Column) -> Column:
    """Moment sums without a shift, which add up over slices of a vector (see ``frequency_major``,
    which shifts the whole vector)."""
    zero = F.struct(*[F.lit(0 if c == "n" else 0.0).alias(c) for c in _MOMENT_FIELDS])
    return F.aggregate(entries, zero, lambda s, q: F.struct(
        (s["n"] + 1).alias("n"), (s["sx"] + q["x"]).alias("sx"), (s["sy"] + q["y"]).alias("sy"),
        (s["sxx"] + q["x"] * q["x"]).alias("sxx"), (s["syy"] + q["y"] * q["y"]).alias("syy"),
        (s["sxy"] + q["x"] * q["y"]).alias("sxy")))


def _corr_from_moments(m: Column) -> Column:
    """Pearson r from moment sums; NULL when a side is constant or there are no pairs."""
    n = m["n"].cast("double")
    cov = n * m["sxy"] - m["sx"] * m["sy"]
    vx = n * m["sxx"] - m["sx"] * m["sx"]
    vy = n * m["syy"] - m["sy"] * m["sy"]
    # a variance within rounding of its sums (which are shifted to be small) is none
    ok = (m["n"] > 1) & (vx > n * m["sxx"] * 1e-13) & (vy > n * m["syy"] * 1e-13)
    r = cov / F.sqrt(vx * vy)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson(a: str | Column, b: str | Column) -> Column:
    """A14 + R11: Pearson correlation of two equal-length arrays over the positions where both
    are present, as one expression: the moments are accumulated and turned into r inside a
    single ``aggregate``, so a copy of the expression (e.g. a NOT NULL filter that the
    optimizer pushes into the pair join) never multiplies the work."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return _moments(_complete_pairs(a, b), finish=_corr_from_moments)


def with_pearson(df: DataFrame, a: str, b: str, out: str = "corr") -> DataFrame:
    return df.withColumn(out, pearson(a, b))


def pairwise_similarity(pairs: DataFrame, enc_col: str, test_col: str, out: str = "corr") -> DataFrame:
    """Correlation of the two sides' vectors and its Fisher z (R12), from one ``aggregate`` whose last step
    makes both: a filter on z, pushed into the pair join, copies one expression and not three."""
    def both(m):
        r = _corr_from_moments(m)
        return F.struct(r.alias("r"), fisher_z(r).alias("z"))
    x = pairs.withColumn("_rz", _moments(_complete_pairs(F.col(enc_col), F.col(test_col)), finish=both))
    return x.withColumns({out: F.col("_rz.r"), f"{out}_z": F.col("_rz.z")}).drop("_rz")


def frequency_major(z: str | Column, n_channels: int, n_freqs: int) -> Column:
    """Reorder a (channel, frequency) vector to frequency-major order, so that the features
    of one frequency (or time bin) are the contiguous slice [f*n_channels, (f+1)*n_channels),
    shifted by the vector's first present element: correlations do not change, and moment sums
    of slices can be subtracted without losing digits.
    Applied on the event side, before the pair join: the cost is per event, not per pair."""
    z = F.col(z) if isinstance(z, str) else z
    k = n_channels * n_freqs
    first = F.coalesce(*[F.get(z, F.lit(i)) for i in range(k)])
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda j: z[(j % n_channels) * n_freqs + F.floor(j / n_channels).cast("int")] - first)


def _slice_moments(a: Column, b: Column, n_channels: int, n_freqs: int) -> Column:
    """Per-frequency moment sums from two frequency-major arrays (complete cases only)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_freqs - 1)),
        lambda f: _plain_moments(_complete_pairs(F.slice(a, f * n_channels + 1, n_channels),
                                                 F.slice(b, f * n_channels + 1, n_channels))))


def leave_one_frequency_out(pairs: DataFrame, enc_fm: str, test_fm: str, n_channels: int, n_freqs: int,
                            out: str = "corr") -> DataFrame:
    """T12 in one pass over the pair table: for every frequency f the correlation over all
    features except those of frequency f, exploded to one row per (pair, drop_freq).

    Inputs are frequency-major arrays (``frequency_major``). Per pair, the moment sums of
    each frequency are computed once from contiguous slices; the moments without f are
    total - part_f, so the eight correlations cost one pass over the features.
    """
    x = pairs.withColumn("_parts", _slice_moments(F.col(enc_fm), F.col(test_fm), n_channels, n_freqs))
    zero = F.struct(*[F.lit(0 if c == "n" else 0.0).alias(c) for c in _MOMENT_FIELDS])
    # _parts is read twice below (total and per-part), so it stays a materialised column
    x = x.withColumn("_tot", F.aggregate("_parts", zero, lambda acc, q: F.struct(
        *[(acc[c] + q[c]).alias(c) for c in _MOMENT_FIELDS])))
    x = x.withColumn("_rest", F.transform("_parts", lambda pp: F.struct(
        *[(F.col("_tot")[c] - pp[c]).alias(c) for c in _MOMENT_FIELDS])))
    x = x.withColumn("_drops", F.transform("_rest", _corr_from_moments))
    x = x.drop("_parts", "_tot", "_rest")
    # posexplode_outer: the array always has n_freqs entries; the outer form keeps the
    # optimizer from inferring a size() filter and pushing it into the pair join
    x = x.select(*[c for c in x.columns if c != "_drops"],
                 F.posexplode_outer("_drops").alias("drop_freq", out))
    return x.withColumn("drop_freq", F.col("drop_freq").cast("bigint")).withColumn(
        f"{out}_z", fisher_z(out))


def channel_means(z: str | Column, n_channels: int, n_freqs: int) -> Column:
    """Mean over the frequency (time) axis per channel, ignoring missing elements."""
    z = F.col(z) if isinstance(z, str) else z

    def one(c):
        vals = F.filter(F.slice(z, c * n_freqs + 1, n_freqs), lambda v: v.isNotNull())
        return F.aggregate(vals, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                           lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["n"] + 1).alias("n")),
                           lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]))
    return F.array(*[one(c) for c in range(n_channels)])


def similarity_over_time(pairs: DataFrame, enc_means: str, test_bm: str, n_channels: int,
                         n_freqs: int, out: str = "corr_z") -> DataFrame:
    """T11 + A7: the test side keeps its time bin (here the frequency index), the encoding
    side is averaged over time (``channel_means``, computed per event); one correlation over
    channels per (pair, bin), then the mean of the Fisher z over bins (missing bins skipped,
    R5) - inside the pair row. ``test_bm`` is the test vector in bin-major order."""
    e = F.col(enc_means)
    t = F.col(test_bm)
    # one correlation per bin, each a single aggregate expression (see ``pearson``)
    x = pairs.withColumn("_r", F.transform(
        F.sequence(F.lit(0), F.lit(n_freqs - 1)),
        lambda b: pearson(e, F.slice(t, b * n_channels + 1, n_channels))))
    x = x.withColumn("_zb", F.filter(F.transform("_r", lambda r: fisher_z(r)),
                                     lambda v: v.isNotNull() & ~F.isnan(v)))
    x = x.withColumn(out, F.aggregate("_zb", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                                      lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["n"] + 1).alias("n")),
                                      lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"])))
    return x.drop("_r", "_zb")


# ---------------------------------------------------------------------------
# three axes: channel x frequency x time bin
#
# Element k of the value is (stacked feature k div n_bins, time bin k mod n_bins). All periods are
# normalised by one baseline, whose statistics pool events and bins, and are built per event before
# the pair join: the test side as an array of bins, each a vector over the stacked features.
# ---------------------------------------------------------------------------

def pooled_feature_stats(baseline: DataFrame, keys: Sequence[str], n_bins: int, features: str = FEATURES) -> DataFrame:
    """A11 over events and time: per ``keys``, arrays ``mu`` and ``sd`` (ddof=0) over the stacked features."""
    long = baseline.select(*keys, F.posexplode(features).alias("k", "x"))
    per = long.groupBy(*keys, F.expr(f"k div {int(n_bins)}").alias("k")).agg(
        F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "mu", "sd"))).alias("_st"))
    return packed.select(*keys, F.col("_st.mu").alias("mu"), F.col("_st.sd").alias("sd"))


def normalise_bins(events: DataFrame, baseline: DataFrame, keys: Sequence[str], n_features: int, n_bins: int,
                   features: str = FEATURES, out: str = "z_bins") -> DataFrame:
    """T8 for a three-axis value: ``out`` is one vector of z over the stacked features for each time bin."""
    j = events.join(pooled_feature_stats(baseline, keys, n_bins, features), list(keys), "left")
    x, mu, sd = F.col(features), F.col("mu"), F.col("sd")
    bins = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.transform(
        F.sequence(F.lit(0), F.lit(n_features - 1)), lambda c: F.try_divide(x[c * n_bins + b] - mu[c], sd[c])))
    # without a baseline in the session every z is NULL
    return j.withColumn(out, bins).drop("mu", "sd")


def keep_bins(bins: str, first: int, last: int, n_features: int) -> Column:
    """The mean over the kept window of time bins ``first..last`` (both inclusive) for every stacked feature,
    missing values skipped."""
    kept = F.slice(F.col(bins), first + 1, last - first + 1)

    def mean_of(c):
        return F.aggregate(kept, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                           lambda acc, b: F.when(b[c].isNull(), acc).otherwise(F.struct(
                               (acc["s"] + b[c]).alias("s"), (acc["n"] + 1).alias("n"))),
                           lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]))
    return F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), mean_of)


def similarity_per_bin(pairs: DataFrame, enc: str, test_bins: str, time_col: str, out: str = "corr") -> DataFrame:
    """One row per (pair, test bin): the correlation over all stacked features of the encoding vector, which
    holds for every bin, with the test side's vector of that bin; NULL where a side is constant. The bins leave
    the pair row only after the correlation, so neither side is exploded before or shuffled again."""
    e, t = F.col(enc), F.col(test_bins)
    x = pairs.withColumn("_r", F.transform(t, lambda b: pearson(e, b)))
    x = x.select(*[c for c in x.columns if c not in ("_r", enc, test_bins)], F.posexplode_outer("_r").alias(time_col, out))
    return x.withColumn(time_col, F.col(time_col).cast("bigint")).withColumn(f"{out}_z", fisher_z(out))
