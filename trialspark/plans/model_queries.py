"""Model tables of the feature trials for every test period, and the models asked of them (T6-T13, F2-F8, ST2-ST12).

The three-axis features of a trial give each period its window of time bins: presentation (encoding) keeps all of
them, the interval before an item (encoding_isi) the first, the end of a presentation (encoding_end) the last, and
distractor events keep every bin apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.nulls import r6, sentinel_to_null
from trialspark.operators import cell_models, features, models, nested, ordered, similarity
from trialspark.operators.stats import frequency_labels
from trialspark.plans import model_oracle as oracle
from trialspark.plans.queries import LIST_ID, LIST_KEYS, SESSION_KEYS, similarity_model_table, trial_log
from trialspark.plans.registry import register
from trialspark.sources import roles
from trialspark.sources.tables import DROPPED_FREQ_HZ_LABELS

N_STACKED = roles.T_CHANNELS * roles.T_FREQS
FIRST_BIN, LAST_BIN = 0, roles.T_BINS - 1
HALF = roles.LIST_LEN // 2
WORD = ["subject", "session", "list", "serialpos", "category", "recalled", "outpos", "first_recalled"]
LAGGED = ["serialpos", "category", "recalled", "outpos"]
PAIR = [f"{c}_encoding" for c in ("subject", "session", "list", "serialpos")]


def _normalised(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    words, distractors, countdowns = roles.feature_trials(spark, sf_dir)
    return tuple(similarity.normalise_bins(x, countdowns, SESSION_KEYS, N_STACKED, roles.T_BINS) for x in (words, distractors))


def _encoding(words: DataFrame) -> DataFrame:
    return words.select(F.col("event").alias("item"), *WORD,
                        similarity.keep_bins("z_bins", FIRST_BIN, LAST_BIN, N_STACKED).alias("z"))


# ---------------------------------------------------------------------------
# distractor period: similarity over time
# ---------------------------------------------------------------------------

def distractor_bins(spark, sf_dir) -> DataFrame:
    """Every word with every distractor event of its list, one row per time bin."""
    words, distractors = _normalised(spark, sf_dir)
    test = distractors.select(F.col("event").alias("item"), *LIST_KEYS, "serialpos", F.col("z_bins").alias("z"))
    pairs = similarity.within_list_pairs(_encoding(words), test, LIST_KEYS, "encoding", "distractor")
    return similarity.similarity_per_bin(pairs, "z_encoding", "z_distractor", "time_distractor").drop(
        "subject_distractor", "session_distractor", "list_distractor")


@register("distractor_similarity_bins", "T6,T7,T8,T11,A11,J9,P19,A14", oracle.DISTRACTOR_BINS)
def distractor_similarity_bins(spark, sf_dir):
    d = distractor_bins(spark, sf_dir)
    return d.select(*PAIR, "item_encoding", "item_distractor", "time_distractor", r6("corr").alias("corr"), r6("corr_z").alias("corr_z"))


def distractor_table(spark, sf_dir) -> DataFrame:
    """A7 by grouping: the mean over time bins by every other column (rows with a missing key go, R5), then P3, F7
    and F8. The centring constants come from list sizes, not from a second pass over the pairs."""
    t = features.mean_over_time(distractor_bins(spark, sf_dir).drop("corr"), "corr_z", "time_distractor", drop_null_keys=True)
    words, distractors, _ = roles.feature_trials(spark, sf_dir)
    st = features.paired_position_constants(words.dropna(subset=WORD), distractors.dropna(subset=["event", "serialpos"]),
                                            LIST_KEYS, "serialpos")
    t = features.centre_scale_with(t, "serialpos_encoding", "serialpos_center", "serialpos_scale",
                                   st.getField("m"), st.getField("mx"), factor=2.0)
    t = t.withColumn("outpos_encoding", sentinel_to_null("outpos_encoding", [roles.NO_OUTPOS]))
    return features.rename_for_period(t, "distractor")


@register("distractor_model_table", "T7,T11,A7,J9,P3,P13,F7,F8", oracle.DISTRACTOR_TABLE)
def distractor_model_table(spark, sf_dir):
    t = distractor_table(spark, sf_dir)
    return t.select(*PAIR, "item_encoding", "category_encoding", "outpos_encoding", "item_first", "item_recalled",
                    "item_distractor", "serialpos_distractor", r6("corr_z").alias("corr_z"),
                    r6("serialpos_center").alias("serialpos_center"), r6("serialpos_scale").alias("serialpos_scale"))


# ---------------------------------------------------------------------------
# periods of the presentation
# ---------------------------------------------------------------------------

def period_pairs(spark, sf_dir, period: str, vector: str = "z") -> tuple[DataFrame, DataFrame]:
    """(pairs, words): within-list pairs of encoding events with the events of ``period`` by its position rule."""
    words, _ = _normalised(spark, sf_dir)
    enc = _encoding(words)
    if period == "encoding_isi":
        lagged = ordered.lag_columns(words, LIST_ID, ["serialpos"], LAGGED)
        test = lagged.select(*LIST_KEYS, *[f"prev_{c}" for c in LAGGED], F.col("z_bins")[FIRST_BIN].alias("z"))
        rule = similarity.position_rule(period, list_len=roles.LIST_LEN, test_prefix="prev_")
    else:
        test = words.select(*WORD, F.col("z_bins")[LAST_BIN].alias("z"))
        rule = similarity.position_rule(period, list_len=roles.LIST_LEN)
    if vector != "z":  # per-event arrays are built before the pair join
        enc, test = (x.withColumn(vector, similarity.frequency_major("z", roles.T_CHANNELS, roles.T_FREQS)).drop("z") for x in (enc, test))
    return similarity.within_list_pairs(enc, test, LIST_KEYS, "encoding", period, rule), words


def _features(pairs: DataFrame, words: DataFrame, period: str) -> DataFrame:
    previous = period == "encoding_isi"
    st = features.split_half_distance_constants(words, LIST_KEYS, HALF, previous)
    f = features.pair_features(pairs, test=period, test_prefix="prev_" if previous else "", distance_constants=st)
    return features.balanced_pairs(features.rename_for_period(f, period))


def period_table(spark, sf_dir, period: str) -> DataFrame:
    """The model table of ``period``: similarity and pair features, balanced over distances."""
    pairs, words = period_pairs(spark, sf_dir, period)
    scored = similarity.pairwise_similarity(pairs, "z_encoding", f"z_{period}").drop("z_encoding", f"z_{period}")
    return _features(scored, words, period)


def _table(period: str):
    other = "item_before_isi_recalled" if period == "encoding_isi" else "current_item_recalled"
    position = f"prev_serialpos_{period}" if period == "encoding_isi" else f"serialpos_{period}"

    def build(spark, sf_dir):
        t = period_table(spark, sf_dir, period)
        return t.select(*PAIR, F.col(position).alias("serialpos_test"), "item_first", "item_recalled", other, "same_category",
                        "abs_serialpos_dist", "pair_recalled", "abs_outpos_dist", "recall_neighbor",
                        r6("abs_serialpos_dist_center").alias("abs_serialpos_dist_center"),
                        r6("abs_serialpos_dist_scale").alias("abs_serialpos_dist_scale"), r6("corr_z").alias("corr_z"))
    return build


register("isi_model_table", "T6,T10,T13,J9,P19,P20,P21,W7,F2-F6,F8", oracle.period_table("encoding_isi"))(_table("encoding_isi"))
register("end_model_table", "T6,T10,T13,J9,P19,P20,P21,F2-F6,F8", oracle.period_table("encoding_end"))(_table("encoding_end"))


@register("pair_features_end", "P19,P20,P21,F2-F6,F8", oracle.PAIR_FEATURES_END)
def pair_features_end(spark, sf_dir):
    """The pair features of the encoding_end period on the word log."""
    log = trial_log(roles.trial_words(spark, sf_dir)).select(*LIST_KEYS, "serialpos", "category", "recalled", "outpos", "first_recalled")
    pairs = similarity.within_list_pairs(log, log, LIST_ID, "encoding", "encoding_end", similarity.position_rule("encoding_end"))
    st = features.split_half_distance_constants(log, LIST_ID, HALF)
    f = features.pair_features(pairs, test="encoding_end", distance_constants=st)
    f = features.balanced_pairs(features.rename_for_period(f, "encoding_end"))
    return f.select(*PAIR, "serialpos_encoding_end", "item_first", "item_recalled", "current_item_recalled", "same_category",
                    "serialpos_dist", "abs_serialpos_dist", "pair_recalled", "outpos_dist", "abs_outpos_dist", "recall_neighbor",
                    r6("abs_serialpos_dist_center").alias("abs_serialpos_dist_center"),
                    r6("abs_serialpos_dist_scale").alias("abs_serialpos_dist_scale"))


# ---------------------------------------------------------------------------
# models: marginal means, F tests, coefficients, sweep
# ---------------------------------------------------------------------------

MEAN_OUT = ["estimate", "se", "bar", "estimate_unscaled", "se_unscaled", "bar_unscaled"]
STRATUM = {"encoding_isi": "item_before_isi_recalled", "encoding_end": "current_item_recalled"}


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def _registered(df: DataFrame, experiment: str, period: str, keys: list[str] = ()) -> cell_models.Model:
    return models.registry_model(df, experiment, period, "m1_final", keys=keys)


def _means(period: str, experiment: str):
    by = [STRATUM[period]] if period in STRATUM else []
    if by and experiment == "catFR1":
        by.append("same_category")

    def build(spark, sf_dir):
        t = period_table(spark, sf_dir, period) if by else distractor_table(spark, sf_dir)
        mm = cell_models.marginal_means(t, _registered(t, experiment, period), "item_recalled", by)
        return _rounded(cell_models.plotted_means(mm).select(*by, "kind", "level", "n", *MEAN_OUT), MEAN_OUT)
    return build


register("marginal_means_isi", "ST1,ST3,ST4,ST9,ST10,ST11", oracle.means("encoding_isi"))(_means("encoding_isi", "FR1"))
register("marginal_means_end", "ST1,ST3,ST4,ST9,ST10,ST11", oracle.means("encoding_end", category=True))(_means("encoding_end", "catFR1"))
register("marginal_means_distractor", "ST1,ST3,ST4,ST9,ST10,ST11,F7", oracle.means("distractor"))(_means("distractor", "catFR1"))


def _type3(period: str, experiment: str):
    def build(spark, sf_dir):
        t = period_table(spark, sf_dir, period)
        return _rounded(cell_models.type3_tests(t, _registered(t, experiment, period)), ["ss", "f"])
    return build


register("type3_isi", "ST1,ST3,ST4,ST8", oracle.type3_period("encoding_isi"))(_type3("encoding_isi", "FR1"))
register("type3_end", "ST1,ST3,ST4,ST8", oracle.type3_period("encoding_end", category=True))(_type3("encoding_end", "catFR1"))


@register("type3_tests", "ST1,ST4,ST8", oracle.TYPE3_WORDS)
def type3_tests(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    return _rounded(cell_models.type3_tests(words, cell_models.model(words, "value", "recalled * urgent")), ["ss", "f"])


@register("type3_event_factors", "ST1,ST2,ST4,ST8", oracle.TYPE3_EVENTS)
def type3_event_factors(spark, sf_dir):
    """F tests with several degrees of freedom: event type and list number as categories, and their interaction."""
    ev = roles.event_log(spark, sf_dir).select("type", "list", "value")
    return _rounded(cell_models.type3_tests(ev, cell_models.model(ev, "value", "type * list", factors=["list"])), ["ss", "f"])


@register("registry_coefficients", "ST1,ST3,ST4,ST5", oracle.COEFFICIENTS)
def registry_coefficients(spark, sf_dir):
    """Every registered final model of the three test periods without a same-category term, on its model table."""
    out = None
    for period in ("encoding_isi", "encoding_end", "distractor"):
        t = distractor_table(spark, sf_dir) if period == "distractor" else period_table(spark, sf_dir, period)
        c = cell_models.coefficients(t, _registered(t, "FR1", period)).select(F.lit(period).alias("period"), "term", "estimate", "se", "t")
        out = c if out is None else out.unionByName(c)
    return _rounded(out, ["estimate", "se", "t"])


@register("registry_fit", "ST1,ST3,ST4,ST5,F4", oracle.REGISTRY_FIT)
def registry_fit(spark, sf_dir):
    """The registered encoding-period model (fixed part) on the feature-event model table."""
    m = similarity_model_table(spark, sf_dir)
    events = roles.feature_events(spark, sf_dir).where(~F.col("is_baseline"))
    st = features.ordered_distance_constants(events, LIST_KEYS)
    m = features.centre_scale_with(m, "abs_serialpos_dist", "abs_serialpos_dist_center", "abs_serialpos_dist_scale",
                                   st.getField("m"), st.getField("mx"))
    return _rounded(models.fit_registry_model(m, "catFR1", "encoding", "m1_final").drop("p_normal"), ["estimate", "se", "t"])


@register("drop_frequency_contrasts", "ST1,ST5,ST9,ST11,ST12,T12,J14", oracle.DROP_CONTRASTS)
def drop_frequency_contrasts(spark, sf_dir):
    """For every dropped frequency the registered model of the encoding_isi period, its contrast of recalled with
    other items within item_before_isi_recalled, labelled with the frequency."""
    pairs, words = period_pairs(spark, sf_dir, "encoding_isi", "fm")
    p = _features(pairs, words, "encoding_isi")
    p = similarity.leave_one_frequency_out(p, "fm_encoding", "fm_encoding_isi", roles.T_CHANNELS, roles.T_FREQS)
    m = _registered(p, "FR1", "encoding_isi", ["drop_freq"])
    c = cell_models.plotted_means(cell_models.marginal_means(p, m, "item_recalled", ["item_before_isi_recalled"])).where("kind = 'contrast'")
    c = c.join(frequency_labels(spark, DROPPED_FREQ_HZ_LABELS), "drop_freq")
    return _rounded(c.select("drop_freq", "dropped_freq_hz", "item_before_isi_recalled", "level", "n", "estimate", "se",
                             "estimate_unscaled", "se_unscaled"), ["estimate", "se", "estimate_unscaled", "se_unscaled"])


@register("nested_slopes", "ST6,ST7,A16", oracle.NESTED_SLOPES)
def nested_slopes(spark, sf_dir):
    """Slope of log value on position for every subject, session and list, shrunk toward the level above."""
    words = roles.trial_words(spark, sf_dir, with_category=False).withColumn("y", F.log("value"))
    out = nested.nested_effects(words, LIST_KEYS, "y", "serialpos")
    return _rounded(out, ["slope", "se", "shrunk"])
