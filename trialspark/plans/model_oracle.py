"""Oracle SQL (DuckDB dialect) for the model tables and models of ``trialspark.plans.model_queries``.

Vectors are rows here (event, stacked feature, bin), constants are windows over the final rows, and models are
solved by Gauss-Jordan elimination in a recursive table, independent of the library's cell moments.
"""

from trialspark.plans.oracle import _BSTATS, _PAIR_KEYS, _PAIRS_LONG
from trialspark.plans.sql_roles import EVENTS, FEATURES, WORDS, WORDS_NO_CAT, with_

_TRIALS = """
ft AS (SELECT vec_id AS event, CAST(floor(vec_id / 192) AS BIGINT) AS subject, CAST(floor(vec_id / 96) AS BIGINT) AS session,
              CAST(floor(vec_id / 12) AS BIGINT) AS list, vec_id % 12 + 1 AS pos, CAST(label AS BIGINT) AS category, embedding FROM embeddings),
wd AS (SELECT event, subject, session, list, CAST(row_number() OVER (PARTITION BY list ORDER BY event) AS BIGINT) AS serialpos, category,
              CAST(embedding[1] > 0 AS BIGINT) AS recalled, embedding[2] AS speed FROM ft WHERE category > 1),
wr AS (SELECT *, CASE WHEN recalled = 1 THEN CAST(row_number() OVER (PARTITION BY list, recalled ORDER BY speed, event) AS BIGINT) END AS outpos FROM wd),
w AS (SELECT event, subject, session, list, serialpos, category, recalled, outpos, coalesce(outpos = 1, false) AS first_recalled,
             lag(serialpos) OVER o AS prev_serialpos, lag(category) OVER o AS prev_category, lag(recalled) OVER o AS prev_recalled,
             lag(outpos) OVER o AS prev_outpos FROM wr WINDOW o AS (PARTITION BY list ORDER BY serialpos)),
fl AS (SELECT event, subject, session, category, CAST((u.k - 1) // 4 AS BIGINT) AS cf, CAST((u.k - 1) % 4 AS BIGINT) AS b, CAST(embedding[u.k] AS DOUBLE) AS x
       FROM ft, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS k) u),
base AS (SELECT subject, session, cf, avg(x) AS mu, stddev_pop(x) AS sd FROM fl WHERE category = 0 GROUP BY ALL),
zb AS (SELECT event, cf, b, (x - mu) / nullif(sd, 0) AS z FROM fl LEFT JOIN base USING (subject, session, cf) WHERE category > 0),
ze AS (SELECT event, cf, avg(z) AS z FROM zb GROUP BY event, cf)"""

_DISTRACTOR = """
db AS (SELECT w.subject AS subject_encoding, w.session AS session_encoding, w.list AS list_encoding, w.serialpos AS serialpos_encoding,
              w.event AS item_encoding, w.category AS category_encoding, w.recalled, w.first_recalled, w.outpos AS outpos_encoding,
              d.event AS item_distractor, d.pos AS serialpos_distractor, zb.b AS time_distractor, corr(zb.z, ze.z) AS r
       FROM w JOIN ft d ON d.category = 1 AND w.subject = d.subject AND w.session = d.session AND w.list = d.list
       JOIN ze ON ze.event = w.event JOIN zb ON zb.event = d.event AND zb.cf = ze.cf GROUP BY ALL)"""

_DISTRACTOR_MODEL = """
dm AS (SELECT * EXCLUDE (r, time_distractor), avg(atanh(r)) AS corr_z FROM db GROUP BY ALL),
dc AS (SELECT *, 2 * (serialpos_encoding - avg(serialpos_encoding) OVER ()) AS ctr FROM dm),
t AS (SELECT *, ctr AS serialpos_center, ctr / max(ctr) OVER () AS serialpos_scale, first_recalled AS item_first,
             CAST(recalled AS BOOLEAN) AS item_recalled FROM dc)"""

DISTRACTOR_BINS = with_(_TRIALS, _DISTRACTOR) + """
SELECT subject_encoding, session_encoding, list_encoding, serialpos_encoding, item_encoding, item_distractor, time_distractor,
       round(r, 6) + 0.0 AS corr, round(atanh(r), 6) + 0.0 AS corr_z FROM db"""

DISTRACTOR_TABLE = with_(_TRIALS, _DISTRACTOR, _DISTRACTOR_MODEL) + """
SELECT subject_encoding, session_encoding, list_encoding, serialpos_encoding, item_encoding, category_encoding, outpos_encoding,
       item_first, item_recalled, item_distractor, serialpos_distractor, round(corr_z, 6) + 0.0 AS corr_z,
       round(serialpos_center, 6) + 0.0 AS serialpos_center, round(serialpos_scale, 6) + 0.0 AS serialpos_scale FROM t"""


def _pair_rows(p: str, other: str, log: str) -> str:
    """Pair features of encoding rows a with test rows b, whose columns have the prefix ``p``."""
    return f"""a.subject AS subject_encoding, a.session AS session_encoding, a.list AS list_encoding, a.serialpos AS serialpos_encoding,
  b.{p}serialpos AS serialpos_test, a.first_recalled AS item_first, CAST(a.recalled AS BOOLEAN) AS item_recalled,
  CAST(b.{p}recalled AS BOOLEAN) AS {other}, coalesce(a.category = b.{p}category, false) AS same_category,
  a.serialpos - b.{p}serialpos AS serialpos_dist, abs(a.serialpos - b.{p}serialpos) AS abs_serialpos_dist,
  a.recalled + b.{p}recalled AS pair_recalled, a.outpos - b.{p}outpos AS outpos_dist, abs(a.outpos - b.{p}outpos) AS abs_outpos_dist,
  coalesce(abs(a.outpos - b.{p}outpos) = 1, false) AS recall_neighbor
  FROM {log} a JOIN {log} b ON a.subject = b.subject AND a.session = b.session AND a.list = b.list
    AND b.{p}serialpos >= 7 AND a.serialpos <= 6"""


_CENTRED = """
pc AS (SELECT *, abs_serialpos_dist - avg(abs_serialpos_dist) OVER () AS ctr FROM p),
ps AS (SELECT *, ctr AS abs_serialpos_dist_center, ctr / max(ctr) OVER () AS abs_serialpos_dist_scale FROM pc),
t AS (SELECT * FROM ps WHERE (serialpos_encoding <> 5 AND abs_serialpos_dist > 2) OR abs_serialpos_dist > 3)"""

OTHER = {"encoding_isi": "item_before_isi_recalled", "encoding_end": "current_item_recalled"}


def _period(period: str) -> tuple[str, ...]:
    p, bin_ = ("prev_", 0) if period == "encoding_isi" else ("", 3)
    pairs = f"""
pe AS (SELECT a.event AS ea, b.event AS eb, {_pair_rows(p, OTHER[period], "w")}),
pr AS (SELECT ea, eb, corr(zb.z, ze.z) AS r FROM pe JOIN ze ON ze.event = ea JOIN zb ON zb.event = eb AND zb.cf = ze.cf AND zb.b = {bin_} GROUP BY ea, eb),
p AS (SELECT pe.*, atanh(r) AS corr_z FROM pe LEFT JOIN pr USING (ea, eb))"""
    return _TRIALS, pairs, _CENTRED


def period_table(period: str) -> str:
    return with_(*_period(period)) + f"""
SELECT subject_encoding, session_encoding, list_encoding, serialpos_encoding, serialpos_test, item_first, item_recalled, {OTHER[period]},
  same_category, abs_serialpos_dist, pair_recalled, abs_outpos_dist, recall_neighbor,
  round(abs_serialpos_dist_center, 6) + 0.0 AS abs_serialpos_dist_center, round(abs_serialpos_dist_scale, 6) + 0.0 AS abs_serialpos_dist_scale,
  round(corr_z, 6) + 0.0 AS corr_z FROM t"""


_WORD_LOG = """
rec AS (SELECT *, row_number() OVER (PARTITION BY list, item ORDER BY mstime, serialpos) AS again,
               CAST(row_number() OVER (PARTITION BY list ORDER BY mstime, serialpos) AS BIGINT) AS outpos FROM words WHERE recalled = 1),
tl AS (SELECT words.*, r.outpos, coalesce(r.outpos = 1, false) AS first_recalled FROM words LEFT JOIN
       (SELECT list, item, outpos FROM rec WHERE again = 1) r ON words.list = r.list AND words.item = r.item)"""

PAIR_FEATURES_END = with_(WORDS, _WORD_LOG, f"""
p AS (SELECT {_pair_rows("", "current_item_recalled", "tl")})""", _CENTRED) + """
SELECT subject_encoding, session_encoding, list_encoding, serialpos_encoding, serialpos_test AS serialpos_encoding_end, item_first,
  item_recalled, current_item_recalled, same_category, serialpos_dist, abs_serialpos_dist, pair_recalled, outpos_dist, abs_outpos_dist,
  recall_neighbor, round(abs_serialpos_dist_center, 6) + 0.0 AS abs_serialpos_dist_center,
  round(abs_serialpos_dist_scale, 6) + 0.0 AS abs_serialpos_dist_scale FROM t"""


# ---------------------------------------------------------------------------
# models
# ---------------------------------------------------------------------------

def _cross(*names: str) -> str:
    return " * ".join(f"CAST({n} AS DOUBLE)" for n in names)


def _design(period: str, category: bool = False) -> dict[str, str]:
    """Columns of the registered final model, with or without a category, in term order."""
    a, c, r = OTHER.get(period, "serialpos_scale"), "same_category", "recall_neighbor"
    kinds = ("item_first", "item_recalled")
    if category:
        terms = [(k,) for k in kinds] + [(a,), (c,), (r,)] + [(k, a) for k in kinds] + [(k, c) for k in kinds]
        terms += [(a, c), (c, r)] + [(k, a, c) for k in kinds]
    else:
        terms = [(k,) for k in kinds] + [(a,)] + ([(r,)] if period in OTHER else []) + [(k, a) for k in kinds]
    return {"(Intercept)": "1.0"} | {":".join(t): _cross(*t) for t in terms}


def rows(design: dict[str, str], extra: str, source: str = "t", y: str = "corr_z", g: str = "0") -> str:
    """CTE ``d``: group g, design row x, response standardised over the group, and ``extra`` columns."""
    return f"""
dy AS (SELECT *, {g} AS g FROM {source} WHERE {y} IS NOT NULL),
ds AS (SELECT g AS sg, avg({y}) AS y_mean, stddev_samp({y}) AS y_sd FROM dy GROUP BY g),
d AS (SELECT g, y_mean, y_sd, ({y} - y_mean) / y_sd AS y, [{", ".join(design.values())}] AS x {extra} FROM dy JOIN ds ON g = sg)"""


#: the normal equations of ``d``, left columns solved away one by one: m = [X'X | X'y | I] becomes [I | b | (X'X)^-1]
_SOLVE = """
ix AS (SELECT DISTINCT g, unnest(range(1, len(x) + 1)) AS i FROM d),
lhs AS (SELECT d.g, a.i, b.i AS j, sum(x[a.i] * x[b.i]) AS v FROM d JOIN ix a ON a.g = d.g JOIN ix b ON b.g = d.g GROUP BY ALL),
rhs AS (SELECT d.g, i, sum(x[i] * y) AS v FROM d JOIN ix ON ix.g = d.g GROUP BY ALL),
lines AS (SELECT lhs.g, lhs.i, list(lhs.v ORDER BY j) || [any_value(rhs.v)] || list(CASE WHEN j = lhs.i THEN 1.0 ELSE 0.0 END ORDER BY j) AS r
          FROM lhs JOIN rhs ON lhs.g = rhs.g AND lhs.i = rhs.i GROUP BY lhs.g, lhs.i),
gj AS (SELECT g, 1 AS k, list(r ORDER BY i) AS m FROM lines GROUP BY g
  UNION ALL SELECT g, k + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m[1]) + 1), lambda j:
    CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] / m[k][k] * m[k][j] END)) FROM gj WHERE k <= len(m)),
sol AS (SELECT g, len(m) AS p, m FROM gj WHERE k = len(m) + 1),
fit AS (SELECT sol.g, p, m, list_transform(range(1, p + 1), lambda i: m[i][p + 1]) AS b FROM sol),
res AS (SELECT d.g, count(*) - any_value(p) AS dof, sum(pow(y - list_inner_product(x, b), 2)) AS rss FROM d JOIN fit ON d.g = fit.g GROUP BY d.g)"""


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE" + ",".join(ctes)


_Z = "1.959963984540054"

_MEANS = """
ln AS (SELECT g, i, {by} item_recalled AS level, avg(xm[i]) AS l FROM d JOIN ix USING (g) GROUP BY ALL),
mn AS (SELECT d.g, {by} item_recalled AS level, count(*) AS n, any_value(y_mean) AS y_mean, any_value(y_sd) AS y_sd FROM d GROUP BY ALL),
lv AS (SELECT g, {by} level, list(l ORDER BY i) AS l FROM ln GROUP BY ALL),
two AS (SELECT g, {by} 'mean' AS kind, CASE WHEN level THEN 'True' ELSE 'False' END AS level, l, n FROM lv JOIN mn USING (g, {by} level)
  UNION ALL SELECT hi.g, {by_hi} 'contrast', 'True - False', list_transform(range(1, len(hi.l) + 1), lambda i: hi.l[i] - lo.l[i]), a.n + b.n
  FROM lv hi JOIN lv lo ON hi.g = lo.g AND {same} hi.level AND NOT lo.level JOIN mn a ON a.g = hi.g AND {same_a} a.level JOIN mn b ON b.g = hi.g AND {same_b} NOT b.level),
est AS (SELECT two.*, list_inner_product(l, b) AS estimate, sqrt(rss / dof * list_sum(list_transform(range(1, p + 1), lambda i:
    l[i] * list_inner_product(l, m[i][p + 2:])))) AS se FROM two JOIN fit ON two.g = fit.g JOIN res ON two.g = res.g),
bars AS (SELECT e.*, ds.y_mean, ds.y_sd, CASE WHEN kind = 'mean' THEN (SELECT c.se * {z} / 2 FROM est c WHERE c.kind = 'contrast' AND c.g = e.g {same_c}) END AS bar
  FROM est e JOIN ds ON e.g = ds.sg)"""


def _means_ctes(by: list[str]) -> str:
    def join(a, b):
        return "".join(f"{a}.{c} = {b}.{c} AND " for c in by)
    return _MEANS.format(by="".join(f"{c}, " for c in by), by_hi="".join(f"hi.{c}, " for c in by), same=join("hi", "lo"),
                         same_a=join("a", "hi"), same_b=join("b", "hi"), same_c="".join(f" AND c.{c} = e.{c}" for c in by), z=_Z)


_UNSCALED = """round(CASE WHEN kind = 'mean' THEN estimate * y_sd + y_mean ELSE estimate * y_sd END, 6) + 0.0 AS estimate_unscaled,
  round(se * y_sd, 6) + 0.0 AS se_unscaled"""


def _source(period: str) -> tuple[str, ...]:
    return _period(period) if period in OTHER else (_TRIALS, _DISTRACTOR, _DISTRACTOR_MODEL)


def means(period: str, category: bool = False) -> str:
    design = _design(period, category)
    by = ([OTHER[period]] if period in OTHER else []) + ["same_category"] * category
    at_mean = design if by else {k: v.replace("CAST(serialpos_scale AS DOUBLE)", "avg(serialpos_scale) OVER ()") for k, v in design.items()}
    keep = f", {', '.join(['item_recalled', *by])}, [{', '.join(at_mean.values())}] AS xm"
    return _recursive(*_source(period), rows(design, keep), _SOLVE, _means_ctes(by)) + f"""
SELECT {"".join(c + ", " for c in by)} kind, level, n, round(estimate, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS se, round(bar, 6) + 0.0 AS bar,
  {_UNSCALED}, round(bar * y_sd, 6) + 0.0 AS bar_unscaled FROM bars"""


def _type3(design: dict[str, tuple[str, str]], source: tuple[str, ...], y: str, table: str) -> str:
    """F of every term from the rise of the residual sum without its columns; ``design``: column -> (term, expression).
    A group of ``d`` is the model without one term, the last the full one."""
    terms = list(dict.fromkeys(t for t, _ in design.values() if t))
    groups = [(t, {c: e for c, (u, e) in design.items() if u != t}) for t in [*terms, "full"]]
    cases = " ".join(f"WHEN '{t}' THEN [{', '.join(cols.values())}]" for t, cols in groups)
    return _recursive(*source, f"""
dy AS (SELECT * FROM {table} WHERE {y} IS NOT NULL),
d AS (SELECT g, CASE g {cases} END AS x, ({y} - avg({y}) OVER (PARTITION BY g)) / stddev_samp({y}) OVER (PARTITION BY g) AS y
      FROM dy, (SELECT unnest([{', '.join(f"'{t}'" for t, _ in groups)}]) AS g))""", _SOLVE) + """
SELECT r.g AS term, CAST(r.dof - f.dof AS BIGINT) AS num_df, CAST(f.dof AS BIGINT) AS den_df, round(r.rss - f.rss, 6) + 0.0 AS ss,
  round((r.rss - f.rss) / (r.dof - f.dof) / (f.rss / f.dof), 6) + 0.0 AS f
FROM res r, res f WHERE f.g = 'full' AND r.g <> 'full'"""


def type3_period(period: str, category: bool = False) -> str:
    """Booleans coded -1/2 and 1/2, which sums to zero."""
    design = {"(Intercept)": ("", "1.0")}
    for name in list(_design(period, category))[1:]:
        design[name] = (name, " * ".join(f"(CAST({v} AS DOUBLE) - 0.5)" for v in name.split(":")))
    return _type3(design, _period(period), "corr_z", "t")


def _sum_coded(col: str, levels: list) -> list[str]:
    last = levels[-1]
    return [f"CASE WHEN {col} = {u!r} THEN 1.0 WHEN {col} = {last!r} THEN -1.0 ELSE 0.0 END" for u in levels[:-1]]


# fixed values: the event types of the generated stream, and its six-hour blocks
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
BLOCKS = [1, 2, 3, 4]


def _event_design() -> dict[str, tuple[str, str]]:
    kinds, blocks = _sum_coded("type", EVENT_TYPES), _sum_coded("list", BLOCKS)
    design = {"1": ("", "1.0")} | {f"t{i}": ("type", e) for i, e in enumerate(kinds)} | {f"l{i}": ("list", e) for i, e in enumerate(blocks)}
    return design | {f"t{i}l{j}": ("type:list", f"({a}) * ({b})") for i, a in enumerate(kinds) for j, b in enumerate(blocks)}


TYPE3_EVENTS = _type3(_event_design(), (EVENTS,), "value", "evlog")


TYPE3_WORDS = _type3({"1": ("", "1.0"), "r": ("recalled", "(recalled - 0.5)"), "u": ("urgent", "(urgent - 0.5)"),
                      "ru": ("recalled:urgent", "(recalled - 0.5) * (urgent - 0.5)")}, (WORDS_NO_CAT,), "value", "words")


def _coefficients(period: str) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in _design(period)) + "]"
    return _recursive(*_source(period), rows(_design(period), ""), _SOLVE) + f"""
SELECT '{period}' AS period, {names}[i] AS term, round(b[i], 6) + 0.0 AS estimate, round(sqrt(rss / dof * m[i][p + 1 + i]), 6) + 0.0 AS se,
  round(b[i] / sqrt(rss / dof * m[i][p + 1 + i]), 6) + 0.0 AS t FROM fit JOIN res USING (g) JOIN ix USING (g)"""


COEFFICIENTS = " UNION ALL ".join(f"SELECT * FROM ({_coefficients(p)})" for p in ("encoding_isi", "encoding_end", "distractor"))

_ENCODING = {"(Intercept)": "1.0", "same_category": "CAST(same_category AS DOUBLE)", "abs_serialpos_dist_scale": "scl",
             "same_category:abs_serialpos_dist_scale": "CAST(same_category AS DOUBLE) * scl"}
_ENCODING_NAMES = "[" + ", ".join(f"'{c}'" for c in _ENCODING) + "]"

REGISTRY_FIT = _recursive(FEATURES, _BSTATS, _PAIRS_LONG, f"""
e0 AS (SELECT {_PAIR_KEYS}, atanh(corr(zb, za)) AS corr_z, abs(serialpos_encoding - serialpos_encoding2) AS dist,
              coalesce(category_encoding = category_encoding2, false) AS same_category FROM pl GROUP BY {_PAIR_KEYS}),
e1 AS (SELECT *, dist - avg(dist) OVER () AS ctr FROM e0),
t AS (SELECT *, ctr / max(ctr) OVER () AS scl FROM e1)""", rows(_ENCODING, ""), _SOLVE) + f"""
SELECT 'catFR1' AS experiment, 'encoding' AS period, 'm1_final' AS model, {_ENCODING_NAMES}[i] AS term, round(b[i], 6) + 0.0 AS estimate,
  round(sqrt(rss / dof * m[i][p + 1 + i]), 6) + 0.0 AS se, round(b[i] / sqrt(rss / dof * m[i][p + 1 + i]), 6) + 0.0 AS t
FROM fit JOIN res USING (g) JOIN ix USING (g)"""

_DROP = """
pe AS (SELECT a.event AS ea, b.event AS eb, {pair}),
pr AS (SELECT ea, eb, f.drop_freq, corr(zb.z, ze.z) AS r FROM pe JOIN ze ON ze.event = ea JOIN zb ON zb.event = eb AND zb.cf = ze.cf AND zb.b = 0
       JOIN (SELECT unnest(range(4)) AS drop_freq) f ON ze.cf % 4 <> f.drop_freq GROUP BY ALL),
p AS (SELECT pe.*, drop_freq, atanh(r) AS corr_z FROM pe JOIN pr USING (ea, eb))"""

DROP_CONTRASTS = _recursive(
    _TRIALS, _DROP.format(pair=_pair_rows("prev_", "item_before_isi_recalled", "w")), _CENTRED,
    rows(_design("encoding_isi"), f", item_recalled, item_before_isi_recalled, [{', '.join(_design('encoding_isi').values())}] AS xm", g="drop_freq"),
    _SOLVE, _means_ctes(["item_before_isi_recalled"])) + f"""
SELECT g AS drop_freq, [3.0, 5.4, 9.7, 17.3][g + 1]::DOUBLE AS dropped_freq_hz, item_before_isi_recalled, level, n,
  round(estimate, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS se, {_UNSCALED} FROM bars WHERE kind = 'contrast'"""


def _level(depth: int, keys: list[str], name: str) -> str:
    own, rest = keys[:depth], keys[depth:]
    cols = ", ".join([*own, *(f"CAST(NULL AS BIGINT) AS {k}" for k in rest)])
    group = f"GROUP BY {', '.join(own)}" if own else ""
    return f"""SELECT {depth} AS depth, '{name}' AS level, {cols}, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy
  FROM yx {group}"""


_KEYS = ["subject", "session", "list"]

NESTED_SLOPES = with_(WORDS_NO_CAT, f"""
yx AS (SELECT subject, session, list, ln(value) AS y, CAST(serialpos AS DOUBLE) AS x FROM words),
u0 AS ({" UNION ALL ".join(_level(k, _KEYS, "total" if not k else _KEYS[k - 1]) for k in range(4))}),
u AS (SELECT *, CASE WHEN n > 1 AND sxx > 1e-9 * n THEN sxy / sxx END AS slope FROM u0),
p2 AS (SELECT depth, sum(greatest(syy - slope * sxy, 0)) / sum(n - 2) AS s2 FROM u WHERE slope IS NOT NULL AND n > 2 GROUP BY depth),
par AS (SELECT u.*, CASE WHEN u.slope IS NOT NULL THEN s2 / u.sxx END AS se2, a.slope AS above FROM u JOIN p2 ON u.depth = p2.depth
        JOIN u a ON a.depth = u.depth - 1 AND (a.depth < 1 OR a.subject = u.subject) AND (a.depth < 2 OR a.session = u.session)),
t2 AS (SELECT depth, greatest(avg(pow(slope - above, 2)) - avg(se2), 0) AS tau2 FROM par WHERE slope IS NOT NULL AND above IS NOT NULL GROUP BY depth)
""") + """
SELECT level, subject, session, list, n, round(slope, 6) + 0.0 AS slope, round(sqrt(se2), 6) + 0.0 AS se,
  round(CASE WHEN slope IS NULL THEN above WHEN above IS NULL THEN slope
        ELSE coalesce(tau2 / nullif(tau2 + se2, 0), 0) * slope + (1 - coalesce(tau2 / nullif(tau2 + se2, 0), 0)) * above END, 6) + 0.0 AS shrunk
FROM par LEFT JOIN t2 USING (depth)"""
