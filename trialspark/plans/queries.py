"""Named queries over the driver's tables, one per operator group of the inventory.

Each query composes library operators on a role-mapped view of the tables (see
``trialspark.sources.roles``) and is paired with an independent SQL oracle in
``trialspark.plans.oracle``. Numeric outputs are rounded (``r6``) and counts are
BIGINT on both sides so the two can be compared by value hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialspark.functions.nulls import r6
from trialspark.operators import summaries
from trialspark.plans import oracle
from trialspark.plans.registry import register
from trialspark.sources import roles
from trialspark.sources.tables import DROPPED_FREQ_HZ_LABELS


@register("within_subject_summary", "W12,W13,A15,A16,ST13", oracle.WITHIN_SUBJECT_SUMMARY)
def within_subject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = roles.trial_words(spark, sf_dir)
    out = summaries.within_subject_summary(
        words, value="value", subject="subject", session="session", lst="list",
        conditions=["category", "recalled"], out_prefix="value")
    return out.select("category", "recalled", r6("mean_value", 4).alias("mean_value"),
                      r6("se_value", 4).alias("se_value"), "n_subjects")


# ---------------------------------------------------------------------------
# trial log: recall order, lags, duplicates, gaps, back-fill
# ---------------------------------------------------------------------------

from trialspark.functions.nulls import eq_false  # noqa: E402
from trialspark.operators import ordered, quality  # noqa: E402

LIST_KEYS = ["subject", "session", "list"]
EV_ORDER = roles.EVENT_ORDER
REC_ORDER = ["mstime", "serialpos"]
# parameters of the event-log checks (ms)
GAP_MIN_MS, GAP_MAX_MS = 60_000, 21_600_000
COUNTDOWN_MIN_GAP_MS = 10_000
SCAN_BUCKET_MS = 900_000
WORD_TYPE, RECALL_TYPE = "view", "purchase"
COUNTDOWN_TYPES = ["signup", "error"]
EXPECTED_LIST_LEN = 4
RARE_ITEM_MIN_SUBJECTS = 25
SHIP_GAP_MIN_MS, SHIP_GAP_MAX_MS = -2_592_000_000, 2_592_000_000


def recall_rows(words: DataFrame) -> DataFrame:
    """Recall rows of the word log: recalled lines in ship order, with output position
    (W2, repeats included) and a repeat flag (W11 keep-first)."""
    rec = words.where(F.col("recalled") == 1)
    rec = ordered.mark_later_duplicates(rec, [*LIST_KEYS, "item"], REC_ORDER, "recall_repeat")
    return ordered.running_position(rec, LIST_KEYS, REC_ORDER, "outpos")


# ``list`` (the order key) identifies a list on its own, so list-level windows and joins of
# the word role key on it alone and reuse the order-key partitioning of the words.
LIST_ID = ["list"]


def trial_log(words: DataFrame) -> DataFrame:
    """words with first output position (W2/W11/J4 as windows), first_recalled
    and lags (W7) - all windows over the list, one shuffle in total."""
    w = ordered.recall_positions(words, LIST_ID, REC_ORDER).drop("outpos_rec")
    w = w.withColumn("first_recalled", eq_false("outpos", 1))
    return ordered.lag_columns(w, LIST_ID, ["serialpos"],
                               ["item", "serialpos", "recalled", "outpos", "category"])


@register("trial_log_lags", "W2,W7,W11,J4,F9,F10", oracle.TRIAL_LOG_LAGS)
def trial_log_lags(spark, sf_dir):
    t = trial_log(roles.trial_words(spark, sf_dir))
    return t.select(*LIST_KEYS, "serialpos", "item", "recalled", "outpos", "first_recalled",
                    "prev_item", "prev_serialpos", "prev_recalled", "prev_outpos", "prev_category")


def scan_bucket():
    """Time range of one step of a two-pass scan over the events of a user."""
    return F.floor(F.col("mstime") / SCAN_BUCKET_MS)


@register("gap_diff_filter", "W8,P26,Q6", oracle.GAP_DIFF_FILTER)
def gap_diff_filter(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir)
    d = ordered.diff(ev, ["subject", "session"], EV_ORDER, "mstime", "gap_ms", bucket=scan_bucket())
    d = d.where(F.col("gap_ms").isNotNull())
    return d.select("event_id", *LIST_KEYS, "gap_ms",
                    ((F.col("gap_ms") > GAP_MIN_MS) & (F.col("gap_ms") < GAP_MAX_MS)).alias("in_range"))


@register("timing_issue_lists", "W8,Q6", oracle.TIMING_ISSUE_LISTS)
def timing_issue_lists(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir)
    return quality.timing_issue_lists(ev, EV_ORDER, GAP_MIN_MS, GAP_MAX_MS)


@register("backfill_value", "P3,W9", oracle.BACKFILL_VALUE)
def backfill_value(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir)
    ev = ev.withColumn("value", F.when(F.col("type") == "error", F.lit(None)).otherwise(F.col("value")))
    f = ordered.backward_fill(ev, ["subject", "session"], EV_ORDER, "value", "value_filled", bucket=scan_bucket())
    return f.select("event_id", r6("value_filled").alias("value_filled"))


@register("event_row_order", "W14,O1", oracle.EVENT_ROW_ORDER)
def event_row_order(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir).select("event_id", "subject", "mstime")
    return ordered.row_order(ev, ["subject", *EV_ORDER]).select("event_id", "row_order")


@register("occurrence_dedupe", "W1,W11,A18", oracle.OCCURRENCE_DEDUPE)
def occurrence_dedupe(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir)
    x = ordered.occurrence_number(ev, [*LIST_KEYS, "type"], EV_ORDER, "item", "rep_num")
    return x.select("event_id", "rep_num", (F.col("rep_num") > 1).alias("is_repeat"))


@register("duplicate_all", "W10,W11,A6,W5,Q7,Q8", oracle.DUPLICATE_ALL)
def duplicate_all(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir)
    q7, q8 = quality.duplicated_lists(ev, EV_ORDER, WORD_TYPE, RECALL_TYPE,
                                      dup_keys=["subject", "list", "item", "type"])
    return q7.withColumn("reason", F.lit("duplicated_encoding")).unionByName(
        q8.withColumn("reason", F.lit("duplicated_data")))


@register("subjects_missing_type", "A1,A2,Q1", oracle.SUBJECTS_MISSING_TYPE)
def subjects_missing_type(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir)
    return quality.subjects_missing_types(ev, [WORD_TYPE, RECALL_TYPE], ["subject", "session"])


@register("rare_items", "A1,A3,J12,Q2", oracle.RARE_ITEMS)
def rare_items(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    return quality.rare_item_subjects(words, RARE_ITEM_MIN_SUBJECTS)


@register("wrong_length_lists", "A4,A5,Q5", oracle.WRONG_LENGTH_LISTS)
def wrong_length_lists(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    return quality.wrong_length_lists(words, EXPECTED_LIST_LEN)


@register("recall_mismatch", "J3,Q4", oracle.RECALL_MISMATCH)
def recall_mismatch(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    recalls = words.where(F.col("status") == "F")
    return quality.recall_mismatch(words, recalls)


def word_bad_lists(words: DataFrame) -> list[DataFrame]:
    recalls = words.where(F.col("status") == "F")
    return [
        quality.repeated_presentations(words, ["serialpos"]),
        quality.recall_mismatch(words, recalls),
        quality.wrong_length_lists(words, EXPECTED_LIST_LEN),
        quality.timing_issue_lists(words, ["serialpos"], SHIP_GAP_MIN_MS, SHIP_GAP_MAX_MS),
    ]


def flagged_words(words: DataFrame) -> DataFrame:
    """Q3-Q6 for the word role as list windows (the recall marker is line status F)."""
    return quality.flag_bad_lists(words.withColumn("_recall_marker", F.col("status") == "F"), LIST_ID,
                                  ["serialpos"], expected_len=EXPECTED_LIST_LEN,
                                  gap=(SHIP_GAP_MIN_MS, SHIP_GAP_MAX_MS), recall_flag="_recall_marker")


@register("bad_list_union", "Q3,Q4,Q5,Q6,Q10,O4", oracle.BAD_LIST_UNION)
def bad_list_union(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    return flagged_words(words).where("bad_list").select(*LIST_KEYS).distinct()


@register("bad_list_union_tables", "Q3,Q4,Q5,Q6,Q10,O4,J2,J3", oracle.BAD_LIST_UNION)
def bad_list_union_tables(spark, sf_dir):
    """The same offenders from the generic form: one offender table per check, union, distinct
    (for logs whose recall events live in a separate table)."""
    words = roles.trial_words(spark, sf_dir, with_category=False)
    _, bad = quality.remove_bad_lists(words, word_bad_lists(words))
    return bad


@register("list_shift_repair", "W3,W4,J5,P25,Q11", oracle.LIST_SHIFT_REPAIR)
def list_shift_repair(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir).where(F.col("type").isin(COUNTDOWN_TYPES))
    fixed = quality.countdown_list_repair(ev, EV_ORDER, file_col=None)
    return fixed.select("event_id", *LIST_KEYS, "type", "type_occurrence", "new_list")


@register("gap_stats_topk", "W8,W9,P26,A8,O2,Q13", oracle.GAP_STATS_TOPK)
def gap_stats_topk(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir).where(F.col("type").isin(COUNTDOWN_TYPES))
    fixed = quality.countdown_list_repair(ev, EV_ORDER, file_col=None)
    fixed = fixed.withColumn("list", F.col("new_list")).drop("new_list")
    gaps = quality.countdown_gaps(fixed, EV_ORDER).where(F.col("diff") > COUNTDOWN_MIN_GAP_MS)
    st = quality.gap_stats(gaps).where((F.col("diff_std") != 0) & (F.col("diff_mean") != 0))
    top = quality.top_by(st, "diff_std_s", 20, ["subject", "session"])
    return top.select("subject", "session", r6("diff_mean_s").alias("diff_mean_s"),
                      r6("diff_std_s").alias("diff_std_s"))


# ---------------------------------------------------------------------------
# normalisation and similarity on the feature events
# ---------------------------------------------------------------------------

from trialspark.functions.nulls import cond_false  # noqa: E402
from trialspark.operators import similarity  # noqa: E402

SESSION_KEYS = ["subject", "session"]
PAIR_OUT = ["subject_encoding", "session_encoding", "list_encoding", "serialpos_encoding",
            "serialpos_encoding2", "category_encoding", "category_encoding2"]


def normalised_features(spark, sf_dir, mode: str = "baseline") -> DataFrame:
    ev = roles.feature_events(spark, sf_dir)
    enc = ev.where(~F.col("is_baseline"))
    layout = (roles.N_CHANNELS, roles.N_FREQS)
    if mode == "baseline":
        return similarity.normalise_to_baseline(enc, ev.where(F.col("is_baseline")), SESSION_KEYS, layout=layout)
    return similarity.normalise_to_self(enc, SESSION_KEYS, layout=layout)


def encoding_pairs(spark, sf_dir) -> DataFrame:
    """Encoding vs itself (suffix encoding2), within-list, later position.
    Per-event derived arrays (frequency-major order, channel means) are computed before the
    join; column pruning keeps only those a query uses."""
    z = normalised_features(spark, sf_dir).select("event", *LIST_KEYS, "serialpos", "category", "z",
                                                  F.col("z_fm").alias("zfm"), F.col("z_mean").alias("zmean"))
    return similarity.within_list_pairs(z, z, LIST_KEYS, "encoding", "encoding2",
                                        similarity.position_rule("encoding2"))


def _z_long(df: DataFrame) -> DataFrame:
    return df.select("event", F.posexplode("z").alias("k", "z")).select(
        "event", F.col("k").cast("bigint").alias("k"), r6("z").alias("z"))


@register("baseline_zscore", "T8,A11", oracle.BASELINE_ZSCORE)
def baseline_zscore(spark, sf_dir):
    return _z_long(normalised_features(spark, sf_dir, "baseline"))


@register("self_zscore", "T9,A11", oracle.SELF_ZSCORE)
def self_zscore(spark, sf_dir):
    return _z_long(normalised_features(spark, sf_dir, "self"))


@register("pairwise_similarity", "T10,T13,J9,P19,P20,A14", oracle.PAIRWISE_SIMILARITY)
def pairwise_similarity(spark, sf_dir):
    p = similarity.pairwise_similarity(encoding_pairs(spark, sf_dir), "z_encoding", "z_encoding2")
    return p.select(*PAIR_OUT, r6("corr").alias("corr"), r6("corr_z").alias("corr_z"))


@register("leave_one_frequency_out", "T12,J14", oracle.LEAVE_ONE_FREQUENCY_OUT)
def leave_one_frequency_out(spark, sf_dir):
    p = similarity.leave_one_frequency_out(encoding_pairs(spark, sf_dir), "zfm_encoding", "zfm_encoding2",
                                           roles.N_CHANNELS, roles.N_FREQS)
    return p.select(*PAIR_OUT, "drop_freq", r6("corr_z").alias("corr_z"))


@register("similarity_over_time", "T11,A7", oracle.SIMILARITY_OVER_TIME)
def similarity_over_time(spark, sf_dir):
    p = similarity.similarity_over_time(encoding_pairs(spark, sf_dir), "zmean_encoding", "zfm_encoding2",
                                        roles.N_CHANNELS, roles.N_FREQS)
    return p.select(*PAIR_OUT, r6("corr_z").alias("corr_z"))


def similarity_model_table(spark, sf_dir) -> DataFrame:
    """Model table of the feature events: within-list similarity plus pair features."""
    p = similarity.pairwise_similarity(encoding_pairs(spark, sf_dir), "z_encoding", "z_encoding2")
    return p.withColumns({
        "same_category": cond_false(F.col("category_encoding") == F.col("category_encoding2")),
        "abs_serialpos_dist": F.abs(F.col("serialpos_encoding") - F.col("serialpos_encoding2")),
    })


@register("similarity_summary", "T8,T10,F2,F3,ST13", oracle.SIMILARITY_SUMMARY)
def similarity_summary(spark, sf_dir):
    m = similarity_model_table(spark, sf_dir)
    out = summaries.within_subject_summary(
        m, value="corr_z", subject="subject_encoding", session="session_encoding", lst="list_encoding",
        conditions=["abs_serialpos_dist", "same_category"], out_prefix="corr_z")
    return out.select("abs_serialpos_dist", "same_category", r6("mean_corr_z").alias("mean_corr_z"),
                      r6("se_corr_z").alias("se_corr_z"), "n_subjects")


# ---------------------------------------------------------------------------
# pair feature tables
# ---------------------------------------------------------------------------

from trialspark.operators import features  # noqa: E402

PF_OUT = ["subject_encoding", "session_encoding", "list_encoding", "serialpos_encoding"]
PF_FEATURES = ["same_category", "serialpos_dist", "abs_serialpos_dist", "pair_recalled",
               "outpos_dist", "abs_outpos_dist", "recall_neighbor"]


def _pf_select(df: DataFrame, extra: list[str]) -> DataFrame:
    return df.select(*PF_OUT, *extra, *PF_FEATURES,
                     r6("abs_serialpos_dist_center").alias("abs_serialpos_dist_center"),
                     r6("abs_serialpos_dist_scale").alias("abs_serialpos_dist_scale"))


@register("pair_features", "P13,P19,P20,F2,F3,F4,F5,F6,F8,F9", oracle.PAIR_FEATURES)
def pair_features(spark, sf_dir):
    log = trial_log(roles.trial_words(spark, sf_dir)).select(
        *LIST_KEYS, "serialpos", "category", "recalled", "outpos", "first_recalled")
    pairs = similarity.within_list_pairs(log, log, LIST_ID, "encoding", "encoding2",
                                         similarity.position_rule("encoding2"))
    # centring constants in closed form from list sizes (no second pass over the pair table)
    consts = features.later_position_distance_constants(log, LIST_ID)
    f = features.rename_for_period(features.pair_features(pairs, distance_constants=consts), "encoding",
                                   test="encoding2")
    return _pf_select(f, ["serialpos_encoding2", "item_first", "item_recalled"])


@register("pair_features_isi", "P19,P20,P21,F2-F6,F8", oracle.PAIR_FEATURES_ISI)
def pair_features_isi(spark, sf_dir):
    log = trial_log(roles.trial_words(spark, sf_dir))
    enc = log.select(*LIST_KEYS, "serialpos", "category", "recalled", "outpos", "first_recalled")
    test = log.select(*LIST_KEYS, "serialpos", "prev_serialpos", "prev_category", "prev_recalled",
                      "prev_outpos")
    pairs = similarity.within_list_pairs(
        enc, test, LIST_ID, "encoding", "encoding_isi",
        similarity.position_rule("encoding_isi", test_prefix="prev_"))
    consts = features.split_half_distance_constants(enc, LIST_ID, roles.LIST_LEN // 2, previous=True)
    f = features.pair_features(pairs, test="encoding_isi", test_prefix="prev_", distance_constants=consts)
    f = features.balanced_pairs(features.rename_for_period(f, "encoding_isi"))
    return _pf_select(f, ["prev_serialpos_encoding_isi", "item_first", "item_recalled",
                          "item_before_isi_recalled"])


@register("position_scale", "F7,A10", oracle.POSITION_SCALE)
def position_scale(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    # centring constants from the per-position counts (one pass over the rows): the row mean
    # of serialpos is sum(pos * n) / sum(n) and its maximum the largest position
    per_pos = words.groupBy("serialpos").agg(F.count(F.lit(1)).alias("n"))
    st = per_pos.agg(F.struct((F.sum(F.col("serialpos") * F.col("n")) / F.sum("n")).alias("m"),
                              F.max("serialpos").alias("mx")).alias("st")).scalar()
    centre = F.lit(2.0) * (F.col("serialpos") - st.getField("m"))
    max_centre = F.lit(2.0) * (st.getField("mx") - st.getField("m"))
    return per_pos.select("serialpos", r6(centre).alias("serialpos_center"),
                          r6(F.try_divide(centre, max_centre)).alias("serialpos_scale"), "n")


# ---------------------------------------------------------------------------
# statistics (ST1-ST12, ST14)
# ---------------------------------------------------------------------------

from trialspark.operators import stats  # noqa: E402


def _round_cols(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


@register("standardised_fit", "ST1,ST4,ST5", oracle.STANDARDISED_FIT)
def standardised_fit(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    res = stats.fit_fixed_effects(words, "value", stats.expand_interactions(["recalled", "urgent"]),
                                  standardise=True)
    return _round_cols(res.select("term", "estimate", "se", "t"), ["estimate", "se", "t"])


@register("per_group_slopes", "ST6", oracle.PER_GROUP_SLOPES)
def per_group_slopes(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False).withColumn("y", F.log("value"))
    res = stats.per_group_effects(words, ["subject"], "y", ["serialpos"])
    return _round_cols(res, ["b_intercept", "b_serialpos"])


@register("per_group_slope_summary", "ST6,A16", oracle.PER_GROUP_SLOPE_SUMMARY)
def per_group_slope_summary(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False).withColumn("y", F.log("value"))
    res = stats.per_group_effects(words, ["subject"], "y", ["serialpos"])
    s = stats.mean_se(res, "b_serialpos")
    return _round_cols(s, ["mean_b_serialpos", "se_b_serialpos"])


@register("variance_by_level", "ST1,ST7", oracle.VARIANCE_BY_LEVEL)
def variance_by_level(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    res = stats.variance_by_level(words, "value", ["subject", "session", "list"], standardise=True)
    return _round_cols(res, ["ss"], 4)


@register("marginal_means", "ST9,ST10,ST11", oracle.MARGINAL_MEANS)
def marginal_means(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=True)
    mm = stats.cell_marginal_means(words, "value", ["recalled", "urgent", "category"], "recalled", ["urgent"])
    scale = mm.select("urgent", "_m", "_s")
    con = stats.revpairwise(mm, "recalled", 1, 0, ["urgent"]).join(scale.dropDuplicates(["urgent"]), "urgent")
    em = mm.select(F.lit("emmean").alias("kind"), "urgent", "recalled", F.col("emmean").alias("estimate"), "se",
                   (F.col("emmean") * F.col("_s") + F.col("_m")).alias("estimate_unscaled"))
    con = con.select(F.lit("contrast").alias("kind"), "urgent", F.lit(None).cast("bigint").alias("recalled"),
                     "estimate", "se", (F.col("estimate") * F.col("_s")).alias("estimate_unscaled"))
    out = em.unionByName(con).withColumnRenamed("se", "_se")
    out = stats.comparison_bars(out.withColumns({"_lo": F.col("estimate") - F.col("_se"),
                                                 "_hi": F.col("estimate") + F.col("_se")}),
                                "estimate", "_lo", "_hi").drop("_lo", "_hi", "_se")
    return _round_cols(out, ["estimate", "SE"]).withColumn("estimate_unscaled", r6("estimate_unscaled", 3))


@register("drop_frequency_sweep", "ST1,ST9,ST11,ST12,T12", oracle.DROP_FREQUENCY_SWEEP)
def drop_frequency_sweep(spark, sf_dir):
    p = similarity.leave_one_frequency_out(encoding_pairs(spark, sf_dir), "zfm_encoding", "zfm_encoding2",
                                           roles.N_CHANNELS, roles.N_FREQS)
    p = p.withColumn("same_category", cond_false(F.col("category_encoding") == F.col("category_encoding2")))
    # ST1 within each dropped frequency + ST9 by same_category, from one cell aggregation
    mm = stats.standardised_cell_means(p, "corr_z", ["drop_freq"], "same_category")
    scale = mm.select("drop_freq", "_m", "_s").distinct()
    con = stats.revpairwise(mm, "same_category", True, False, [], keys=["drop_freq"])
    con = con.join(scale, "drop_freq").join(stats.frequency_labels(spark, DROPPED_FREQ_HZ_LABELS), "drop_freq")
    con = stats.unstandardise(con, {"estimate": "corr_z_diff_unscaled", "se": "corr_z_diff_unscaled_SE"},
                              F.col("_m"), F.col("_s"), contrast=True)
    return _round_cols(con.select("drop_freq", "dropped_freq_hz", "estimate", "se", "corr_z_diff_unscaled",
                                  "corr_z_diff_unscaled_SE"),
                       ["estimate", "se", "corr_z_diff_unscaled", "corr_z_diff_unscaled_SE"])


@register("logistic_fit", "ST14")
def logistic_fit(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False).withColumn("value_k", F.col("value") / 10000)
    return stats.logistic_fixed_effects(words, "recalled", ["urgent", "value_k"])


# ---------------------------------------------------------------------------
# epochs and spectral power
# ---------------------------------------------------------------------------

from trialspark.operators import epochs as ep_ops  # noqa: E402
from trialspark.operators import spectral  # noqa: E402
from trialspark.sources.tables import FREQ_MAX_HZ, FREQ_MIN_HZ, LINE_NOISE_HZ, N_FREQS, RESAMPLE_HZ, WAVELET_WIDTH  # noqa: E402

# epoch parameters for the event log (ms): 2 h before each purchase, 30 min buffers, 30 min bins
EPOCH_START_MS, EPOCH_END_MS, EPOCH_BUFFER_MS, EPOCH_BIN_MS = -7_200_000, 0, 1_800_000, 1_800_000
ONSET_TYPE = "purchase"
GRID_MS = 10_000  # regular grid of the power epochs at the lower of the two sampling rates
FAST_HZ = 2000.0


def _event_epochs(spark, sf_dir) -> DataFrame:
    ev = roles.event_log(spark, sf_dir)
    on = ev.where(F.col("type") == ONSET_TYPE).select(F.col("event_id").alias("onset_id"), "subject", "mstime")
    samples = ev.select("subject", "mstime", "value")
    return ep_ops.epochs(on, samples, ["subject"], "mstime", "mstime",
                         EPOCH_START_MS, EPOCH_END_MS, EPOCH_BUFFER_MS)


@register("epoch_bins", "J13,T1,T2,T6,T7,A13", oracle.EPOCH_BINS)
def epoch_bins(spark, sf_dir):
    e = ep_ops.demean(_event_epochs(spark, sf_dir), "value")
    e = ep_ops.time_bins(ep_ops.trim_buffer(e, EPOCH_START_MS, EPOCH_END_MS),
                         EPOCH_START_MS, EPOCH_END_MS, EPOCH_BIN_MS)
    out = ep_ops.binned_mean(e, "value", ["onset_id"])
    return out.select("onset_id", "time_bin", r6("value").alias("value"), "n")


@register("epoch_power", "T3,T4,T5,T6,A12")
def epoch_power(spark, sf_dir):
    """Wavelet power of every onset's epoch. Subjects are recorded at one of two rates (a grid step of GRID_MS or half
    of it, one step at the higher rate being a sample of FAST_HZ); all epochs are brought to RESAMPLE_HZ."""
    e = _event_epochs(spark, sf_dir)
    lo = EPOCH_START_MS - EPOCH_BUFFER_MS
    fast = F.col("subject") % 2 == 0
    e = e.withColumn("rate", F.when(fast, FAST_HZ).otherwise(FAST_HZ / 2)).withColumn("step", F.when(fast, GRID_MS // 2).otherwise(GRID_MS))
    # irregular samples onto the subject's grid (the latest value of a step's samples is not known: their sum)
    g = e.withColumn("idx", F.floor((F.col("rel") - lo) / F.col("step")).cast("int")).groupBy("onset_id", "rate", "idx").agg(
        F.sum("value").alias("v"))
    # one list of (idx, v): two lists would drop NULLs of one side and lose their pairing
    per = g.where("v is not null").groupBy("onset_id", "rate").agg(F.collect_list(F.struct("idx", "v")).alias("g")).select(
        "onset_id", "rate", "g.idx", "g.v")
    seconds = lambda ms: ms / (GRID_MS // 2) / FAST_HZ  # noqa: E731 - of the recording's clock
    freqs = spectral.logspace_freqs(FREQ_MIN_HZ, FREQ_MAX_HZ, N_FREQS)
    return spectral.epoch_power(per, ["onset_id"], "idx", "v", "rate", seconds(EPOCH_END_MS - EPOCH_START_MS + 2 * EPOCH_BUFFER_MS), freqs,
                                seconds(EPOCH_BUFFER_MS), RESAMPLE_HZ, width=WAVELET_WIDTH, stop=LINE_NOISE_HZ)


# ---------------------------------------------------------------------------
# pair screen, sample summary, coverage, quality report
# ---------------------------------------------------------------------------

from trialspark.operators import pairs_screen, summary  # noqa: E402

MICRO_TYPE, DEPTH_TYPE = "uD", "D"


def _contacts(spark, sf_dir) -> DataFrame:
    p = roles.read_table(spark, sf_dir, "part")
    contact_type = (F.when(F.col("p_size") < 3, "uD").when(F.col("p_size") <= 35, "D").otherwise("S"))
    return p.select(F.col("p_partkey").alias("contact"), F.col("p_brand").alias("label"),
                    contact_type.alias("type"),
                    F.col("p_size").cast("double").alias("vox_x"), (F.col("p_retailprice") / 100).alias("vox_y"),
                    F.length("p_name").cast("double").alias("vox_z"))


def _pairs(spark, sf_dir) -> DataFrame:
    words = roles.trial_words(spark, sf_dir, with_category=False)
    w = Window.partitionBy(*LIST_KEYS).orderBy("serialpos")
    # screen role: subject = order year, montage = priority class; pairs = consecutive lines
    return words.select(F.col("session").alias("subject"), F.col("urgent").alias("montage"), "list", "serialpos",
                        F.col("item").alias("contact_1"), F.lead("item").over(w).alias("contact_2")
                        ).where(F.col("contact_2").isNotNull())


@register("pair_screen", "P14,P15,P16,P17,P18,J7,W6,O4,Q14", oracle.PAIR_SCREEN)
def pair_screen(spark, sf_dir):
    c = _contacts(spark, sf_dir)
    out = pairs_screen.screen_pairs(_pairs(spark, sf_dir), c, [], micro_type=MICRO_TYPE,
                                    depth_type=DEPTH_TYPE, count_keys=["subject", "montage"])
    return out.select("subject", "montage", "list", "serialpos", "contact_1", "contact_2", "label",
                      r6("dist").alias("dist"), "n_contacts")


@register("sample_summary", "ST15,A1,A9,A20", oracle.SAMPLE_SUMMARY)
def sample_summary(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    return summary.sample_summary(words, "subject", "session", "list",
                                  pairs_per=summary.min_of_counts(words, "subject", "session"))


@register("region_coverage", "P22,P23,P24,J10,J11,A1,A21,ST16", oracle.REGION_COVERAGE)
def region_coverage(spark, sf_dir):
    t = lambda n: roles.read_table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey")
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject"))
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal")
    c = t("customer").select(F.col("c_custkey").alias("subject"), "c_nationkey")
    n = t("nation")
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sn_name"))
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cn_name"))
    loc = li.join(o, "l_orderkey").join(s, "l_suppkey").join(sn, "s_nationkey").join(c, "subject").join(cn, "c_nationkey")
    atlas1 = F.when(F.col("s_acctbal") < 0, F.lit(" Unknown ")).otherwise(F.concat(F.lit('"'), "sn_name", F.lit('"')))
    loc = loc.select("subject", summary.coalesce_priority(
        [summary.clean_atlas(atlas1), summary.clean_atlas("cn_name")]).alias("subregion_original"))
    lookup = n.join(t("region"), n.n_regionkey == F.col("r_regionkey")).select(
        F.lower("n_name").alias("subregion_original"), F.col("r_name").alias("region"))
    cov, _ = summary.region_coverage(loc, lookup)
    return cov


@register("quality_report", "A17,A19,J2,Q2,Q10", oracle.QUALITY_REPORT)
def quality_report(spark, sf_dir):
    words = roles.trial_words(spark, sf_dir, with_category=False)
    # a list belongs to one subject, so its flags do not depend on the subjects that go before
    rare = quality.rare_item_subjects(words, RARE_ITEM_MIN_SUBJECTS).withColumn("_rare", F.lit(True))
    flagged = flagged_words(words).join(rare, "subject", "left").withColumn("_rare", F.coalesce("_rare", F.lit(False)))
    return quality.flag_step_counts(flagged, [("raw", F.lit(True)), ("no_rare_item_subjects", ~F.col("_rare")),
                                              ("no_bad_lists", ~F.col("_rare") & ~F.col("bad_list"))])


# ---------------------------------------------------------------------------
# end-to-end log cleaning
# ---------------------------------------------------------------------------

from trialspark.operators import cleaning  # noqa: E402


@register("clean_event_log", "P2,P10,Q1,Q3,Q6,Q10,J2,W2,W7,W11,J4,F9,F10,O4", oracle.CLEAN_EVENT_LOG)
def clean_event_log(spark, sf_dir):
    ev = roles.event_log(spark, sf_dir)
    out = cleaning.clean_log(ev, EV_ORDER, WORD_TYPE, RECALL_TYPE, list_length=None,
                             gap_min=GAP_MIN_MS, gap_max=GAP_MAX_MS)
    return out.select("event_id", *LIST_KEYS, "type", "item", "outpos", "recall_repeat", "first_recalled",
                      "prev_item", "prev_outpos")


@register("input_checks", "A17,S4", oracle.INPUT_CHECKS)
def input_checks(spark, sf_dir):
    """Key combinations of the word log occurring more than once (expected 0);
    S4: orders (expected inputs) with no line items (found inputs)."""
    from trialspark.sources.tables import missing_inputs
    words = roles.trial_words(spark, sf_dir, with_category=False)
    dup = quality.assert_unique(words, ["list", "serialpos"])
    orders = roles.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("list"))
    missing = missing_inputs(orders, words.select("list"), ["list"])
    return dup.agg(F.lit("duplicate_word_keys").alias("check"), F.count(F.lit(1)).alias("n")).unionByName(
        missing.agg(F.lit("orders_without_lines").alias("check"), F.count(F.lit(1)).alias("n")))


@register("similarity_variance_by_level", "ST1,ST7,T10", oracle.SIMILARITY_VARIANCE_BY_LEVEL)
def similarity_variance_by_level(spark, sf_dir):
    """Nested sums of squares of scale(corr_z) over subject / session / list of the model table."""
    m = similarity_model_table(spark, sf_dir)
    res = stats.variance_by_level(m, "corr_z", ["subject_encoding", "session_encoding", "list_encoding"],
                                  standardise=True)
    return _round_cols(res.withColumn("level", F.regexp_replace("level", "_encoding$", "")), ["ss"], 4)
