"""Oracle SQL (DuckDB dialect) for the named queries.

Each statement is a direct, row-level transcription of the operator semantics
(windows written out literally), independent of the algebraic rewrites used by
the Spark plans.
"""

from trialspark.plans.sql_roles import EVENTS, FEATURES, WORDS, WORDS_NO_CAT, with_  # noqa: F401

WITHIN_SUBJECT_SUMMARY = with_(WORDS, """
t1 AS (SELECT *, avg(value) OVER (PARTITION BY subject, session, list) AS list_mean FROM words),
t2 AS (SELECT *, avg(list_mean) OVER (PARTITION BY subject, session) AS sess_mean FROM t1),
t3 AS (SELECT *, avg(sess_mean) OVER (PARTITION BY subject) AS sub_mean FROM t2),
t4 AS (SELECT *, value - list_mean + avg(sub_mean) OVER () AS adj FROM t3),
l1 AS (SELECT subject, session, list, category, recalled, avg(adj) AS a FROM t4
       GROUP BY subject, session, list, category, recalled),
l2 AS (SELECT subject, session, category, recalled, avg(a) AS a FROM l1
       GROUP BY subject, session, category, recalled),
l3 AS (SELECT subject, category, recalled, avg(a) AS a FROM l2 GROUP BY subject, category, recalled)
""") + """
SELECT category, recalled,
       round(avg(a), 4) + 0.0 AS mean_value,
       round(stddev_samp(a) / sqrt(count(*)), 4) + 0.0 AS se_value,
       count(*) AS n_subjects
FROM l3 GROUP BY category, recalled
"""

TRIAL_LOG_LAGS = with_(WORDS, """
rec AS (
  SELECT *,
         row_number() OVER (PARTITION BY subject, session, list, item ORDER BY mstime, serialpos) > 1 AS recall_repeat,
         CAST(row_number() OVER (PARTITION BY subject, session, list ORDER BY mstime, serialpos) AS BIGINT) AS outpos
  FROM words WHERE recalled = 1),
firstrec AS (SELECT subject, session, list, item, outpos FROM rec WHERE NOT recall_repeat),
w AS (SELECT w.*, f.outpos FROM words w LEFT JOIN firstrec f
        ON w.subject = f.subject AND w.session = f.session AND w.list = f.list AND w.item = f.item)
""") + """
SELECT subject, session, list, serialpos, item, recalled, outpos,
       coalesce(outpos = 1, false) AS first_recalled,
       lag(item) OVER win AS prev_item, lag(serialpos) OVER win AS prev_serialpos,
       lag(recalled) OVER win AS prev_recalled, lag(outpos) OVER win AS prev_outpos,
       lag(category) OVER win AS prev_category
FROM w WINDOW win AS (PARTITION BY subject, session, list ORDER BY serialpos)
"""

GAP_DIFF_FILTER = with_(EVENTS, """
d AS (SELECT *, mstime - lag(mstime) OVER (PARTITION BY subject, session ORDER BY mstime, event_id) AS gap_ms
      FROM evlog)
""") + """
SELECT event_id, subject, session, list, gap_ms, (gap_ms > 60000 AND gap_ms < 21600000) AS in_range
FROM d WHERE gap_ms IS NOT NULL
"""

TIMING_ISSUE_LISTS = with_(EVENTS, """
d AS (SELECT *, mstime - lag(mstime) OVER (PARTITION BY subject, session, list ORDER BY mstime, event_id) AS gap
      FROM evlog)
""") + """
SELECT DISTINCT subject, session, list FROM d WHERE gap > 21600000 OR gap < 60000
"""

BACKFILL_VALUE = with_(EVENTS, """
v AS (SELECT *, CASE WHEN type = 'error' THEN NULL ELSE value END AS v FROM evlog)
""") + """
SELECT event_id,
       round(first_value(v IGNORE NULLS) OVER (PARTITION BY subject, session ORDER BY mstime, event_id
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS value_filled
FROM v
"""

EVENT_ROW_ORDER = with_(EVENTS) + """
SELECT event_id, CAST(row_number() OVER (ORDER BY subject NULLS FIRST, mstime NULLS FIRST, event_id NULLS FIRST) - 1 AS BIGINT) AS row_order
FROM evlog
"""

OCCURRENCE_DEDUPE = with_(EVENTS) + """
SELECT event_id,
       CASE WHEN item IS NULL THEN NULL ELSE
         CAST(row_number() OVER (PARTITION BY subject, session, list, type, item ORDER BY mstime, event_id) AS BIGINT)
       END AS rep_num,
       CASE WHEN item IS NULL THEN NULL ELSE
         row_number() OVER (PARTITION BY subject, session, list, type, item ORDER BY mstime, event_id) > 1
       END AS is_repeat
FROM evlog
"""

DUPLICATE_ALL = with_(EVENTS, """
wr AS (SELECT * FROM evlog WHERE type IN ('view', 'purchase')),
a AS (SELECT *, count(*) OVER (PARTITION BY subject, list, item, type) > 1 AS dup FROM wr),
b AS (SELECT *, row_number() OVER (PARTITION BY subject, list, item, type ORDER BY mstime, event_id) > 1 AS dup
      FROM wr),
fa AS (SELECT subject, session, list, type FROM a GROUP BY subject, session, list, type
       HAVING sum(CAST(dup AS BIGINT)) = count(item)),
fb AS (SELECT subject, session, list, type FROM b GROUP BY subject, session, list, type
       HAVING sum(CAST(dup AS BIGINT)) = count(item)),
na AS (SELECT subject, session, list, count(DISTINCT type) AS n_types FROM fa GROUP BY subject, session, list),
nb AS (SELECT subject, session, list, count(DISTINCT type) AS n_types FROM fb GROUP BY subject, session, list)
""") + """
SELECT DISTINCT fa.subject, fa.session, fa.list, 'duplicated_encoding' AS reason
FROM fa JOIN na USING (subject, session, list) WHERE fa.type = 'view' AND na.n_types = 1
UNION ALL
SELECT DISTINCT fb.subject, fb.session, fb.list, 'duplicated_data' AS reason
FROM fb JOIN nb USING (subject, session, list) WHERE fb.type = 'view' AND nb.n_types = 2
"""

SUBJECTS_MISSING_TYPE = with_(EVENTS) + """
SELECT subject, session, count(DISTINCT type) AS n_types
FROM evlog WHERE type IN ('view', 'purchase')
GROUP BY subject, session HAVING count(DISTINCT type) <> 2
"""

RARE_ITEMS = with_(WORDS_NO_CAT, """
per_item AS (SELECT item, count(DISTINCT subject) AS n FROM words GROUP BY item)
""") + """
SELECT DISTINCT subject FROM words WHERE item IN (SELECT item FROM per_item WHERE n < 25)
"""

WRONG_LENGTH_LISTS = with_(WORDS_NO_CAT) + """
SELECT subject, session, list, count(*) AS n_items FROM words
GROUP BY subject, session, list HAVING count(*) <> 4
"""

_MISMATCH = """
recf AS (SELECT DISTINCT subject, session, list, item FROM words WHERE status = 'F'),
mm AS (
  SELECT DISTINCT w.subject, w.session, w.list
  FROM words w LEFT JOIN recf r
    ON w.subject = r.subject AND w.session = r.session AND w.list = r.list AND w.item = r.item
  WHERE (w.recalled = 1 AND r.item IS NULL) OR (w.recalled = 0 AND r.item IS NOT NULL))"""

RECALL_MISMATCH = with_(WORDS_NO_CAT, _MISMATCH) + "SELECT * FROM mm"

BAD_LIST_UNION = with_(WORDS_NO_CAT, _MISMATCH, """
rep AS (SELECT DISTINCT subject, session, list FROM (
          SELECT *, row_number() OVER (PARTITION BY subject, session, list, item ORDER BY serialpos) AS rn
          FROM words) WHERE rn > 1),
wl AS (SELECT subject, session, list FROM words GROUP BY subject, session, list HAVING count(*) <> 4),
tim AS (SELECT DISTINCT subject, session, list FROM (
          SELECT *, mstime - lag(mstime) OVER (PARTITION BY subject, session, list ORDER BY serialpos) AS gap
          FROM words) WHERE gap > 2592000000 OR gap < -2592000000)
""") + """
SELECT * FROM rep UNION SELECT * FROM mm UNION SELECT * FROM wl UNION SELECT * FROM tim
"""

_REPAIR = """
cd AS (SELECT * FROM evlog WHERE type IN ('signup', 'error')),
x1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject, session, list, type ORDER BY mstime, event_id) - 1
                      AS BIGINT) AS type_occurrence FROM cd),
x2 AS (SELECT *, max(type_occurrence) OVER (PARTITION BY subject, session, list) AS max_occ FROM x1),
x3 AS (SELECT *, coalesce(max_occ >= 2 OR (max_occ <> 0 AND list > 1), false) AS bad_list FROM x2),
x4 AS (SELECT *, bool_or(bad_list) OVER (PARTITION BY subject, session, list) AS any_bad FROM x3),
fix AS (SELECT DISTINCT subject, session FROM x4 WHERE type_occurrence = 1 AND list = 1),
x5 AS (SELECT x4.*, fix.subject IS NOT NULL AS to_fix FROM x4
       LEFT JOIN fix ON x4.subject = fix.subject AND x4.session = fix.session),
fixed AS (
  SELECT event_id, subject, session, list, type, type_occurrence, mstime,
         CASE WHEN (type_occurrence = 1 AND list = 1 AND NOT any_bad) OR (to_fix AND list <> 1)
              THEN list + 1 ELSE list END AS new_list
  FROM x5 WHERE NOT bad_list)"""

LIST_SHIFT_REPAIR = with_(EVENTS, _REPAIR) + """
SELECT event_id, subject, session, list, type, type_occurrence, new_list FROM fixed
"""

GAP_STATS_TOPK = with_(EVENTS, _REPAIR, """
g1 AS (SELECT event_id, subject, session, new_list AS list, mstime,
              mstime - lag(mstime) OVER (PARTITION BY subject, session, new_list ORDER BY mstime, event_id) AS d
       FROM fixed),
g2 AS (SELECT *, first_value(d IGNORE NULLS) OVER (PARTITION BY subject, session, list ORDER BY mstime, event_id
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS diff FROM g1),
st AS (SELECT subject, session, avg(diff) AS diff_mean, stddev_samp(diff) AS diff_std
       FROM g2 WHERE diff > 10000 GROUP BY subject, session)
""") + """
SELECT subject, session, round(diff_mean / 1000, 6) + 0.0 AS diff_mean_s, round(diff_std / 1000, 6) + 0.0 AS diff_std_s
FROM st WHERE diff_std <> 0 AND diff_mean <> 0
ORDER BY diff_std / 1000 DESC NULLS LAST, subject, session LIMIT 20
"""

_BSTATS = """
bstats AS (SELECT subject, session, k, avg(x) AS mu, stddev_pop(x) AS sd FROM flong WHERE is_baseline
           GROUP BY subject, session, k),
z AS (SELECT f.event, f.subject, f.session, f.list, f.serialpos, f.category, f.k,
             (f.x - b.mu) / nullif(b.sd, 0) AS z
      FROM flong f LEFT JOIN bstats b ON f.subject = b.subject AND f.session = b.session AND f.k = b.k
      WHERE NOT f.is_baseline)"""

BASELINE_ZSCORE = with_(FEATURES, _BSTATS) + "SELECT event, k, round(z, 6) + 0.0 AS z FROM z"

SELF_ZSCORE = with_(FEATURES, """
sstats AS (SELECT subject, session, k, avg(x) AS mu, stddev_pop(x) AS sd FROM flong WHERE NOT is_baseline
           GROUP BY subject, session, k)
""") + """
SELECT f.event, f.k, round((f.x - s.mu) / nullif(s.sd, 0), 6) + 0.0 AS z
FROM flong f JOIN sstats s ON f.subject = s.subject AND f.session = s.session AND f.k = s.k
WHERE NOT f.is_baseline
"""

_PAIRS_LONG = """
pl AS (SELECT a.subject AS subject_encoding, a.session AS session_encoding, a.list AS list_encoding,
              a.serialpos AS serialpos_encoding, b.serialpos AS serialpos_encoding2,
              a.category AS category_encoding, b.category AS category_encoding2, a.k, a.z AS za, b.z AS zb
       FROM z a JOIN z b ON a.subject = b.subject AND a.session = b.session AND a.list = b.list
                        AND a.k = b.k AND b.serialpos > a.serialpos)"""

_PAIR_KEYS = ("subject_encoding, session_encoding, list_encoding, serialpos_encoding, serialpos_encoding2, "
              "category_encoding, category_encoding2")

PAIRWISE_SIMILARITY = with_(FEATURES, _BSTATS, _PAIRS_LONG, f"""
pr AS (SELECT {_PAIR_KEYS}, corr(zb, za) AS r FROM pl GROUP BY {_PAIR_KEYS})
""") + f"""
SELECT {_PAIR_KEYS}, round(r, 6) + 0.0 AS corr, round(atanh(r), 6) + 0.0 AS corr_z FROM pr
"""

LEAVE_ONE_FREQUENCY_OUT = with_(FEATURES, _BSTATS, _PAIRS_LONG, f"""
d AS (SELECT CAST(range AS BIGINT) AS drop_freq FROM range(8)),
pr AS (SELECT {_PAIR_KEYS}, d.drop_freq, corr(zb, za) AS r FROM pl JOIN d ON pl.k % 8 <> d.drop_freq
       GROUP BY {_PAIR_KEYS}, d.drop_freq)
""") + f"""
SELECT {_PAIR_KEYS}, drop_freq, round(atanh(r), 6) + 0.0 AS corr_z FROM pr
"""

SIMILARITY_OVER_TIME = with_(FEATURES, _BSTATS, f"""
zc AS (SELECT *, k // 8 AS c, k % 8 AS t FROM z),
enc AS (SELECT event, subject, session, list, serialpos, category, c, avg(z) AS ze
        FROM zc GROUP BY event, subject, session, list, serialpos, category, c),
pt AS (SELECT a.subject AS subject_encoding, a.session AS session_encoding, a.list AS list_encoding,
              a.serialpos AS serialpos_encoding, b.serialpos AS serialpos_encoding2,
              a.category AS category_encoding, b.category AS category_encoding2, b.t,
              corr(b.z, a.ze) AS r
       FROM enc a JOIN zc b ON a.subject = b.subject AND a.session = b.session AND a.list = b.list
                           AND a.c = b.c AND b.serialpos > a.serialpos
       GROUP BY ALL)
""") + f"""
SELECT {_PAIR_KEYS}, round(avg(CASE WHEN isnan(atanh(r)) THEN NULL ELSE atanh(r) END), 6) + 0.0 AS corr_z
FROM pt GROUP BY {_PAIR_KEYS}
"""

SIMILARITY_SUMMARY = with_(FEATURES, _BSTATS, _PAIRS_LONG, f"""
pr AS (SELECT {_PAIR_KEYS}, atanh(corr(zb, za)) AS corr_z FROM pl GROUP BY {_PAIR_KEYS}),
m AS (SELECT subject_encoding AS subject, session_encoding AS session, list_encoding AS list,
             abs(serialpos_encoding - serialpos_encoding2) AS abs_serialpos_dist,
             coalesce(category_encoding = category_encoding2, false) AS same_category, corr_z FROM pr),
t1 AS (SELECT *, avg(corr_z) OVER (PARTITION BY subject, session, list) AS list_mean FROM m),
t2 AS (SELECT *, avg(list_mean) OVER (PARTITION BY subject, session) AS sess_mean FROM t1),
t3 AS (SELECT *, avg(sess_mean) OVER (PARTITION BY subject) AS sub_mean FROM t2),
t4 AS (SELECT *, corr_z - list_mean + avg(sub_mean) OVER () AS adj FROM t3),
l1 AS (SELECT subject, session, list, abs_serialpos_dist, same_category, avg(adj) AS a FROM t4
       GROUP BY subject, session, list, abs_serialpos_dist, same_category),
l2 AS (SELECT subject, session, abs_serialpos_dist, same_category, avg(a) AS a FROM l1
       GROUP BY subject, session, abs_serialpos_dist, same_category),
l3 AS (SELECT subject, abs_serialpos_dist, same_category, avg(a) AS a FROM l2
       GROUP BY subject, abs_serialpos_dist, same_category)
""") + """
SELECT abs_serialpos_dist, same_category, round(avg(a), 6) + 0.0 AS mean_corr_z,
       round(stddev_samp(a) / sqrt(count(*)), 6) + 0.0 AS se_corr_z, count(*) AS n_subjects
FROM l3 GROUP BY abs_serialpos_dist, same_category
"""

_TRIAL_LOG = """
rec AS (
  SELECT *,
         row_number() OVER (PARTITION BY subject, session, list, item ORDER BY mstime, serialpos) > 1 AS recall_repeat,
         CAST(row_number() OVER (PARTITION BY subject, session, list ORDER BY mstime, serialpos) AS BIGINT) AS outpos
  FROM words WHERE recalled = 1),
firstrec AS (SELECT subject, session, list, item, outpos FROM rec WHERE NOT recall_repeat),
w0 AS (SELECT w.*, f.outpos FROM words w LEFT JOIN firstrec f
        ON w.subject = f.subject AND w.session = f.session AND w.list = f.list AND w.item = f.item),
tl AS (SELECT *, coalesce(outpos = 1, false) AS first_recalled,
              lag(serialpos) OVER win AS prev_serialpos, lag(recalled) OVER win AS prev_recalled,
              lag(outpos) OVER win AS prev_outpos, lag(category) OVER win AS prev_category
       FROM w0 WINDOW win AS (PARTITION BY subject, session, list ORDER BY serialpos))"""

PAIR_FEATURES = with_(WORDS, _TRIAL_LOG, """
p AS (SELECT a.subject AS subject_encoding, a.session AS session_encoding, a.list AS list_encoding,
             a.serialpos AS serialpos_encoding, b.serialpos AS serialpos_encoding2,
             a.first_recalled AS item_first, CAST(a.recalled AS BOOLEAN) AS item_recalled,
             coalesce(a.category = b.category, false) AS same_category,
             a.serialpos - b.serialpos AS serialpos_dist,
             abs(a.serialpos - b.serialpos) AS abs_serialpos_dist,
             a.recalled + b.recalled AS pair_recalled,
             a.outpos - b.outpos AS outpos_dist, abs(a.outpos - b.outpos) AS abs_outpos_dist,
             coalesce(abs(a.outpos - b.outpos) = 1, false) AS recall_neighbor
      FROM tl a JOIN tl b ON a.subject = b.subject AND a.session = b.session AND a.list = b.list
                         AND b.serialpos > a.serialpos),
c AS (SELECT *, abs_serialpos_dist - avg(abs_serialpos_dist) OVER () AS ctr FROM p)
""") + """
SELECT subject_encoding, session_encoding, list_encoding, serialpos_encoding, serialpos_encoding2,
       item_first, item_recalled, same_category, serialpos_dist, abs_serialpos_dist, pair_recalled,
       outpos_dist, abs_outpos_dist, recall_neighbor,
       round(ctr, 6) + 0.0 AS abs_serialpos_dist_center,
       round(ctr / max(ctr) OVER (), 6) + 0.0 AS abs_serialpos_dist_scale
FROM c
"""

PAIR_FEATURES_ISI = with_(WORDS, _TRIAL_LOG, """
p AS (SELECT a.subject AS subject_encoding, a.session AS session_encoding, a.list AS list_encoding,
             a.serialpos AS serialpos_encoding, b.prev_serialpos AS prev_serialpos_encoding_isi,
             a.first_recalled AS item_first, CAST(a.recalled AS BOOLEAN) AS item_recalled,
             CAST(b.prev_recalled AS BOOLEAN) AS item_before_isi_recalled,
             coalesce(a.category = b.prev_category, false) AS same_category,
             a.serialpos - b.prev_serialpos AS serialpos_dist,
             abs(a.serialpos - b.prev_serialpos) AS abs_serialpos_dist,
             a.recalled + b.prev_recalled AS pair_recalled,
             a.outpos - b.prev_outpos AS outpos_dist, abs(a.outpos - b.prev_outpos) AS abs_outpos_dist,
             coalesce(abs(a.outpos - b.prev_outpos) = 1, false) AS recall_neighbor
      FROM tl a JOIN tl b ON a.subject = b.subject AND a.session = b.session AND a.list = b.list
                         AND b.prev_serialpos >= 7 AND a.serialpos <= 6),
c AS (SELECT *, abs_serialpos_dist - avg(abs_serialpos_dist) OVER () AS ctr FROM p),
s AS (SELECT *, ctr / max(ctr) OVER () AS scl FROM c)
""") + """
SELECT subject_encoding, session_encoding, list_encoding, serialpos_encoding, prev_serialpos_encoding_isi,
       item_first, item_recalled, item_before_isi_recalled, same_category, serialpos_dist, abs_serialpos_dist,
       pair_recalled, outpos_dist, abs_outpos_dist, recall_neighbor,
       round(ctr, 6) + 0.0 AS abs_serialpos_dist_center, round(scl, 6) + 0.0 AS abs_serialpos_dist_scale
FROM s WHERE (serialpos_encoding <> 5 AND abs_serialpos_dist > 2) OR abs_serialpos_dist > 3
"""

POSITION_SCALE = with_(WORDS_NO_CAT, """
c AS (SELECT serialpos, 2.0 * (serialpos - avg(serialpos) OVER ()) AS ctr FROM words),
s AS (SELECT serialpos, ctr, ctr / max(ctr) OVER () AS scl FROM c)
""") + """
SELECT serialpos, round(any_value(ctr), 6) + 0.0 AS serialpos_center, round(any_value(scl), 6) + 0.0 AS serialpos_scale,
       count(*) AS n
FROM s GROUP BY serialpos
"""

_ZWORDS = """
z AS (SELECT *, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS y FROM words)"""

STANDARDISED_FIT = with_(WORDS_NO_CAT, _ZWORDS, """
c AS (SELECT recalled, urgent, count(*) AS n, avg(y) AS m, sum(y) AS s, sum(y * y) AS ss FROM z
      GROUP BY recalled, urgent),
s2 AS (SELECT sum(ss - s * s / n) / (sum(n) - 4) AS s2 FROM c),
w AS (SELECT max(CASE WHEN recalled = 0 AND urgent = 0 THEN m END) AS m00,
             max(CASE WHEN recalled = 1 AND urgent = 0 THEN m END) AS m10,
             max(CASE WHEN recalled = 0 AND urgent = 1 THEN m END) AS m01,
             max(CASE WHEN recalled = 1 AND urgent = 1 THEN m END) AS m11,
             max(CASE WHEN recalled = 0 AND urgent = 0 THEN n END) AS n00,
             max(CASE WHEN recalled = 1 AND urgent = 0 THEN n END) AS n10,
             max(CASE WHEN recalled = 0 AND urgent = 1 THEN n END) AS n01,
             max(CASE WHEN recalled = 1 AND urgent = 1 THEN n END) AS n11 FROM c),
e AS (
  SELECT '(Intercept)' AS term, m00 AS est, sqrt(s2 / n00) AS se FROM w, s2
  UNION ALL SELECT 'recalled', m10 - m00, sqrt(s2 * (1.0 / n10 + 1.0 / n00)) FROM w, s2
  UNION ALL SELECT 'urgent', m01 - m00, sqrt(s2 * (1.0 / n01 + 1.0 / n00)) FROM w, s2
  UNION ALL SELECT 'recalled:urgent', m11 - m10 - m01 + m00,
                   sqrt(s2 * (1.0 / n00 + 1.0 / n01 + 1.0 / n10 + 1.0 / n11)) FROM w, s2)
""") + """
SELECT term, round(est, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS se, round(est / se, 6) + 0.0 AS t FROM e
"""

_SLOPES = """
g AS (SELECT subject, count(*) AS n, regr_intercept(ln(value), serialpos) AS b0,
             regr_slope(ln(value), serialpos) AS b1
      FROM words GROUP BY subject)"""

PER_GROUP_SLOPES = with_(WORDS_NO_CAT, _SLOPES) + """
SELECT subject, n, round(CASE WHEN isnan(b1) THEN NULL ELSE b0 END, 6) + 0.0 AS b_intercept,
       round(CASE WHEN isnan(b1) THEN NULL ELSE b1 END, 6) + 0.0 AS b_serialpos,
       CASE WHEN b1 IS NULL OR isnan(b1) THEN 'singular design' END AS reason
FROM g
"""

PER_GROUP_SLOPE_SUMMARY = with_(WORDS_NO_CAT, _SLOPES, """
b AS (SELECT CASE WHEN isnan(b1) THEN NULL ELSE b1 END AS b FROM g)
""") + """
SELECT round(avg(b), 6) + 0.0 AS mean_b_serialpos, round(stddev_samp(b) / sqrt(count(b)), 6) + 0.0 AS se_b_serialpos,
       count(b) AS n_groups FROM b
"""

VARIANCE_BY_LEVEL = with_(WORDS_NO_CAT, _ZWORDS, """
lm AS (SELECT subject, session, list, y,
              avg(y) OVER (PARTITION BY subject, session, list) AS ml,
              avg(y) OVER (PARTITION BY subject, session) AS ms,
              avg(y) OVER (PARTITION BY subject) AS mu,
              avg(y) OVER () AS m FROM z),
cnt AS (SELECT count(*) AS n, count(DISTINCT (subject, session, list)) AS nl,
               count(DISTINCT (subject, session)) AS ns, count(DISTINCT subject) AS nu FROM z)
""") + """
SELECT 'residual' AS level, CAST((SELECT n - nl FROM cnt) AS BIGINT) AS df, round(sum((y - ml) * (y - ml)), 4) + 0.0 AS ss FROM lm
UNION ALL SELECT 'list', CAST((SELECT nl - ns FROM cnt) AS BIGINT), round(sum((ml - ms) * (ml - ms)), 4) + 0.0 FROM lm
UNION ALL SELECT 'session', CAST((SELECT ns - nu FROM cnt) AS BIGINT), round(sum((ms - mu) * (ms - mu)), 4) + 0.0 FROM lm
UNION ALL SELECT 'subject', CAST((SELECT nu - 1 FROM cnt) AS BIGINT), round(sum((mu - m) * (mu - m)), 4) + 0.0 FROM lm
"""

MARGINAL_MEANS = with_(WORDS, _ZWORDS, """
cells AS (SELECT recalled, urgent, category, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM z
          GROUP BY recalled, urgent, category),
s2 AS (SELECT sum(ss - s * s / n) / (sum(n) - count(*)) AS s2 FROM cells),
sc AS (SELECT avg(value) AS mv, stddev_samp(value) AS sv FROM words),
mm AS (SELECT urgent, recalled, sum(s) / sum(n) AS emmean, sqrt((SELECT s2 FROM s2) / sum(n)) AS se
       FROM cells GROUP BY urgent, recalled),
con AS (SELECT a.urgent, a.emmean - b.emmean AS est, sqrt(a.se * a.se + b.se * b.se) AS se
        FROM mm a JOIN mm b ON a.urgent = b.urgent AND a.recalled = 1 AND b.recalled = 0)
""") + """
SELECT 'emmean' AS kind, urgent, recalled, round(emmean, 6) + 0.0 AS estimate,
       round(emmean * sv + mv, 3) + 0.0 AS estimate_unscaled, round(se, 6) + 0.0 AS SE FROM mm, sc
UNION ALL
SELECT 'contrast', urgent, CAST(NULL AS BIGINT), round(est, 6) + 0.0, round(est * sv, 3) + 0.0, round(se, 6) + 0.0
FROM con, sc
"""

DROP_FREQUENCY_SWEEP = with_(FEATURES, _BSTATS, _PAIRS_LONG, f"""
d AS (SELECT CAST(range AS BIGINT) AS drop_freq FROM range(8)),
pr AS (SELECT {_PAIR_KEYS}, d.drop_freq, atanh(corr(zb, za)) AS corr_z FROM pl JOIN d ON pl.k % 8 <> d.drop_freq
       GROUP BY {_PAIR_KEYS}, d.drop_freq),
p AS (SELECT drop_freq, coalesce(category_encoding = category_encoding2, false) AS same_category, corr_z
      FROM pr WHERE corr_z IS NOT NULL),
sc AS (SELECT drop_freq, avg(corr_z) AS m, stddev_samp(corr_z) AS s FROM p GROUP BY drop_freq),
yy AS (SELECT p.drop_freq, same_category, (corr_z - m) / s AS y FROM p JOIN sc ON p.drop_freq = sc.drop_freq),
cells AS (SELECT drop_freq, same_category, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM yy
          GROUP BY drop_freq, same_category),
s2 AS (SELECT drop_freq, sum(ss - s * s / n) / (sum(n) - count(*)) AS s2 FROM cells GROUP BY drop_freq),
mm AS (SELECT c.drop_freq, c.same_category, c.s / c.n AS emmean, sqrt(s2.s2 / c.n) AS se
       FROM cells c JOIN s2 ON c.drop_freq = s2.drop_freq),
con AS (SELECT a.drop_freq, a.emmean - b.emmean AS est, sqrt(a.se * a.se + b.se * b.se) AS se
        FROM mm a JOIN mm b ON a.drop_freq = b.drop_freq AND a.same_category AND NOT b.same_category),
hz AS (SELECT CAST(drop_freq AS BIGINT) AS drop_freq, CAST(hz AS DOUBLE) AS dropped_freq_hz FROM (
         VALUES (0, 3.0), (1, 5.4), (2, 9.7), (3, 17.3), (4, 31.1), (5, 55.9), (6, 100.3), (7, 180.0))
       AS t(drop_freq, hz))
""") + """
SELECT con.drop_freq, hz.dropped_freq_hz, round(est, 6) + 0.0 AS estimate, round(con.se, 6) + 0.0 AS se,
       round(est * sc.s, 6) + 0.0 AS corr_z_diff_unscaled, round(con.se * sc.s, 6) + 0.0 AS corr_z_diff_unscaled_SE
FROM con JOIN sc ON con.drop_freq = sc.drop_freq JOIN hz ON con.drop_freq = hz.drop_freq
"""

EPOCH_BINS = with_(EVENTS, """
ons AS (SELECT event_id AS onset_id, subject, mstime AS t0 FROM evlog WHERE type = 'purchase'),
ep AS (SELECT o.onset_id, s.mstime - o.t0 AS rel, s.value
       FROM ons o JOIN evlog s ON s.subject = o.subject AND s.mstime BETWEEN o.t0 - 9000000 AND o.t0 + 1800000),
dm AS (SELECT onset_id, rel, value - avg(value) OVER (PARTITION BY onset_id) AS v FROM ep),
b AS (SELECT onset_id, CAST(-7200000 + (ceil((rel + 7200000) / 1800000.0) - 1) * 1800000 AS BIGINT) AS time_bin, v
      FROM dm WHERE rel > -7200000 AND rel <= 0)
""") + """
SELECT onset_id, time_bin, round(avg(v), 6) + 0.0 AS value, count(*) AS n FROM b GROUP BY onset_id, time_bin
"""

PAIR_SCREEN = with_(WORDS_NO_CAT, r"""
pr AS (SELECT session AS subject, urgent AS montage, list, serialpos, item AS contact_1,
              lead(item) OVER (PARTITION BY subject, session, list ORDER BY serialpos) AS contact_2 FROM words),
ct AS (SELECT p_partkey AS contact, p_brand AS label,
              CASE WHEN p_size < 3 THEN 'uD' WHEN p_size <= 35 THEN 'D' ELSE 'S' END AS type,
              CAST(p_size AS DOUBLE) AS vox_x, p_retailprice / 100 AS vox_y, CAST(length(p_name) AS DOUBLE) AS vox_z
       FROM part),
prs AS (SELECT pr.*, concat_ws('-', a.label, b.label) AS label, a.type AS type_1, b.type AS type_2
        FROM pr JOIN ct a ON pr.contact_1 = a.contact JOIN ct b ON pr.contact_2 = b.contact
        WHERE pr.contact_2 IS NOT NULL),
f AS (SELECT * FROM prs WHERE type_1 IS DISTINCT FROM 'uD' AND type_1 IS NOT NULL AND type_1 = type_2),
j AS (SELECT f.*, a.label AS label_1, b.label AS label_2,
             sqrt((a.vox_x - b.vox_x) ^ 2 + (a.vox_y - b.vox_y) ^ 2 + (a.vox_z - b.vox_z) ^ 2) AS dist,
             string_split(f.label, '-') AS parts
      FROM f JOIN ct a ON f.contact_1 = a.contact JOIN ct b ON f.contact_2 = b.contact
      WHERE a.vox_x IS NOT NULL AND a.vox_y IS NOT NULL AND a.vox_z IS NOT NULL
        AND b.vox_x IS NOT NULL AND b.vox_y IS NOT NULL AND b.vox_z IS NOT NULL),
two AS (SELECT * FROM j WHERE len(parts) = 2 AND label_1 = parts[1] AND label_2 = parts[2]
          AND (abs(TRY_CAST(nullif(regexp_extract(parts[1], '(\d+)$', 1), '') AS INTEGER)
                   - TRY_CAST(nullif(regexp_extract(parts[2], '(\d+)$', 1), '') AS INTEGER)) = 1
               OR type_1 IS DISTINCT FROM 'D')
          AND dist < 25),
u AS (SELECT * FROM two UNION ALL SELECT * FROM j WHERE len(parts) > 2),
c AS (SELECT *, count(label) OVER (PARTITION BY subject, montage) AS n_contacts FROM u)
""") + """
SELECT subject, montage, list, serialpos, contact_1, contact_2, label, round(dist, 6) + 0.0 AS dist, n_contacts
FROM c WHERE n_contacts >= 10
"""

SAMPLE_SUMMARY = with_(WORDS_NO_CAT, """
ns AS (SELECT subject, count(DISTINCT session) AS x FROM words GROUP BY subject),
nl AS (SELECT subject, session, count(DISTINCT list) AS x FROM words GROUP BY subject, session),
mp AS (SELECT subject, min(c) AS x FROM (SELECT subject, session, count(*) AS c FROM words GROUP BY subject, session)
       GROUP BY subject)
""") + """
SELECT 'sessions_per_subject' AS measure, CAST(x AS BIGINT) AS bin, count(*) AS n FROM ns GROUP BY x
UNION ALL SELECT 'lists_per_session', CAST(x AS BIGINT), count(*) FROM nl GROUP BY x
UNION ALL SELECT 'min_pairs_per_subject', CAST(floor(x / 20) * 20 AS BIGINT), count(*) FROM mp GROUP BY floor(x / 20)
"""

REGION_COVERAGE = """
WITH loc AS (
  SELECT o.o_custkey AS subject,
         CASE WHEN s.s_acctbal < 0 THEN ' Unknown ' ELSE '"' || sn.n_name || '"' END AS a1,
         cn.n_name AS a2
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
       JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey),
cl AS (SELECT subject, trim(lower(trim(a1)), '"') AS c1, trim(lower(trim(a2)), '"') AS c2 FROM loc),
cl2 AS (SELECT subject,
               coalesce(CASE WHEN c1 IN ('nan', 'unknown', 'none', '[]', 'left tc', '', ' ') THEN NULL ELSE c1 END,
                        CASE WHEN c2 IN ('nan', 'unknown', 'none', '[]', 'left tc', '', ' ') THEN NULL ELSE c2 END) AS sub
        FROM cl),
lk AS (SELECT lower(n.n_name) AS subregion_original, r.r_name AS region
       FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
j AS (SELECT cl2.subject, lk.region FROM cl2 LEFT JOIN lk ON cl2.sub = lk.subregion_original WHERE cl2.sub IS NOT NULL),
per AS (SELECT subject, region, count(*) AS n FROM j WHERE region IS NOT NULL GROUP BY subject, region)
SELECT region, count(DISTINCT subject) AS n_subjects FROM per
WHERE n > 0 AND region NOT IN ('Other', 'Other Cortex', 'Subcortical', 'Occipital') GROUP BY region
UNION ALL SELECT 'Total Subjects', count(DISTINCT subject) FROM per
"""

QUALITY_REPORT = with_(WORDS_NO_CAT, """
per_item AS (SELECT item, count(DISTINCT subject) AS n FROM words GROUP BY item),
rare AS (SELECT DISTINCT subject FROM words WHERE item IN (SELECT item FROM per_item WHERE n < 25)),
s1 AS (SELECT * FROM words WHERE subject NOT IN (SELECT subject FROM rare)),
recf AS (SELECT DISTINCT subject, session, list, item FROM s1 WHERE status = 'F'),
mm AS (SELECT DISTINCT w.subject, w.session, w.list FROM s1 w LEFT JOIN recf r
         ON w.subject = r.subject AND w.session = r.session AND w.list = r.list AND w.item = r.item
       WHERE (w.recalled = 1 AND r.item IS NULL) OR (w.recalled = 0 AND r.item IS NOT NULL)),
rep AS (SELECT DISTINCT subject, session, list FROM (
          SELECT *, row_number() OVER (PARTITION BY subject, session, list, item ORDER BY serialpos) AS rn FROM s1)
        WHERE rn > 1),
wl AS (SELECT subject, session, list FROM s1 GROUP BY subject, session, list HAVING count(*) <> 4),
tim AS (SELECT DISTINCT subject, session, list FROM (
          SELECT *, mstime - lag(mstime) OVER (PARTITION BY subject, session, list ORDER BY serialpos) AS gap FROM s1)
        WHERE gap > 2592000000 OR gap < -2592000000),
bad AS (SELECT * FROM rep UNION SELECT * FROM mm UNION SELECT * FROM wl UNION SELECT * FROM tim),
s2 AS (SELECT s1.* FROM s1 ANTI JOIN bad ON s1.subject = bad.subject AND s1.session = bad.session AND s1.list = bad.list)
""") + """
SELECT CAST(0 AS BIGINT) AS step, 'raw' AS step_name, count(*) AS n_rows, count(DISTINCT subject) AS n_subjects,
       count(DISTINCT (subject, session)) AS n_sessions FROM words
UNION ALL SELECT 1, 'no_rare_item_subjects', count(*), count(DISTINCT subject), count(DISTINCT (subject, session)) FROM s1
UNION ALL SELECT 2, 'no_bad_lists', count(*), count(DISTINCT subject), count(DISTINCT (subject, session)) FROM s2
"""

CLEAN_EVENT_LOG = with_(EVENTS, """
x0 AS (SELECT * FROM evlog WHERE list > 0),
bs AS (SELECT subject FROM x0 WHERE type IN ('view', 'purchase') GROUP BY subject HAVING count(DISTINCT type) <> 2),
x1 AS (SELECT * FROM x0 WHERE subject NOT IN (SELECT subject FROM bs)),
w AS (SELECT * FROM x1 WHERE type = 'view'),
rep AS (SELECT DISTINCT subject, session, list FROM (
          SELECT *, row_number() OVER (PARTITION BY subject, session, list, item ORDER BY mstime, event_id) AS rn
          FROM w) WHERE rn > 1 AND item IS NOT NULL),
tim AS (SELECT DISTINCT subject, session, list FROM (
          SELECT *, mstime - lag(mstime) OVER (PARTITION BY subject, session, list ORDER BY mstime, event_id) AS g
          FROM w) WHERE g > 21600000 OR g < 60000),
bad AS (SELECT * FROM rep UNION SELECT * FROM tim),
x2 AS (SELECT x1.* FROM x1 ANTI JOIN bad ON x1.subject = bad.subject AND x1.session = bad.session
                                         AND x1.list = bad.list),
rec AS (SELECT *,
               row_number() OVER (PARTITION BY subject, session, list, item ORDER BY mstime, event_id) > 1
                 AS recall_repeat,
               CAST(row_number() OVER (PARTITION BY subject, session, list ORDER BY mstime, event_id) AS BIGINT)
                 AS outpos
        FROM x2 WHERE type = 'purchase'),
fr AS (SELECT subject, session, list, item, outpos FROM rec WHERE NOT recall_repeat),
w2 AS (SELECT w.*, fr.outpos FROM x2 w LEFT JOIN fr ON w.subject = fr.subject AND w.session = fr.session
                                                 AND w.list = fr.list AND w.item = fr.item
       WHERE w.type = 'view'),
w3 AS (SELECT *, coalesce(outpos = 1, false) AS first_recalled, lag(item) OVER win AS prev_item,
              lag(outpos) OVER win AS prev_outpos
       FROM w2 WINDOW win AS (PARTITION BY subject, session, list ORDER BY mstime, event_id))
""") + """
SELECT event_id, subject, session, list, type, item, outpos, CAST(NULL AS BOOLEAN) AS recall_repeat, first_recalled,
       prev_item, prev_outpos FROM w3
UNION ALL
SELECT event_id, subject, session, list, type, item, outpos, recall_repeat, CAST(NULL AS BOOLEAN),
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM rec
UNION ALL
SELECT event_id, subject, session, list, type, item, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN),
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM x2 WHERE type NOT IN ('view', 'purchase')
"""

INPUT_CHECKS = with_(WORDS_NO_CAT) + """
SELECT 'duplicate_word_keys' AS "check", count(*) AS n FROM (
  SELECT list, serialpos FROM words GROUP BY list, serialpos HAVING count(*) > 1)
UNION ALL
SELECT 'orders_without_lines', count(*) FROM (
  SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT DISTINCT list FROM words))
"""

SIMILARITY_VARIANCE_BY_LEVEL = with_(FEATURES, _BSTATS, _PAIRS_LONG, f"""
pr AS (SELECT {_PAIR_KEYS}, atanh(corr(zb, za)) AS corr_z FROM pl GROUP BY {_PAIR_KEYS}),
zs AS (SELECT subject_encoding AS subject, session_encoding AS session, list_encoding AS list,
              (corr_z - avg(corr_z) OVER ()) / stddev_samp(corr_z) OVER () AS y
       FROM pr WHERE corr_z IS NOT NULL),
lm AS (SELECT subject, session, list, y,
              avg(y) OVER (PARTITION BY subject, session, list) AS ml,
              avg(y) OVER (PARTITION BY subject, session) AS ms,
              avg(y) OVER (PARTITION BY subject) AS mu,
              avg(y) OVER () AS m FROM zs),
cnt AS (SELECT count(*) AS n, count(DISTINCT (subject, session, list)) AS nl,
               count(DISTINCT (subject, session)) AS ns, count(DISTINCT subject) AS nu FROM zs)
""") + """
SELECT 'residual' AS level, CAST((SELECT n - nl FROM cnt) AS BIGINT) AS df, round(sum((y - ml) * (y - ml)), 4) + 0.0 AS ss FROM lm
UNION ALL SELECT 'list', CAST((SELECT nl - ns FROM cnt) AS BIGINT), round(sum((ml - ms) * (ml - ms)), 4) + 0.0 FROM lm
UNION ALL SELECT 'session', CAST((SELECT ns - nu FROM cnt) AS BIGINT), round(sum((ms - mu) * (ms - mu)), 4) + 0.0 FROM lm
UNION ALL SELECT 'subject', CAST((SELECT nu - 1 FROM cnt) AS BIGINT), round(sum((mu - m) * (mu - m)), 4) + 0.0 FROM lm
"""
