"""Oracle SQL (DuckDB dialect) for ``trialspark.plans.power_queries``: every pair's samples are differenced before they
are cut, and every period has its own plain range join."""

from trialspark.plans.sql_roles import EVENTS, with_

_S, _U = 10_800_000, 43_200_000  # sample grid, one second of the windows

# fixed values: period, onset type, start, end, buffer (seconds), kept window (milliseconds), bin width (seconds)
_PERIODS = [("encoding", "view", -0.5, 2.1, 1, 15, 1575, None), ("encoding_end", "view", 1.1, 1.6, 1, None, None, None),
            ("encoding_isi", "view", -0.7, 0, 1, None, None, None), ("distractor", "error", -20, 0, 1, None, None, 1),
            ("countdown", "signup", 0, 10, 1, None, None, 1)]


def _ms(v, per=1):
    return "NULL" if v is None else str(round(v * _U / per))


_VALUES = ", ".join(f"('{p}', '{t}', {_ms(a)}, {_ms(b)}, {_ms(f)}, {_ms(k, 1000)}, {_ms(h, 1000)}, {_ms(w)})" for p, t, a, b, f, k, h, w in _PERIODS)

PERIOD_BINS = with_(EVENTS, f"""
ev AS (SELECT *, subject // 10 AS ses FROM evlog),
sm AS (SELECT ses, type AS contact, mstime // {_S} * {_S} AS t, avg(value) AS v FROM ev GROUP BY ALL),
pr AS (SELECT * FROM (VALUES ('click', 'error'), ('error', 'purchase'), ('purchase', 'signup'), ('signup', 'view')) AS p(contact_1, contact_2)),
ch AS (SELECT a.ses, contact_1, contact_2, a.t, a.v - b.v AS v FROM pr JOIN sm a ON a.contact = contact_1
       JOIN sm b ON b.contact = contact_2 AND a.ses = b.ses AND a.t = b.t WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
pp AS (SELECT * FROM (VALUES {_VALUES}) AS p(period, type, lo, hi, buf, klo, khi, w)),
ep AS (SELECT e.event_id AS onset_id, pp.*, contact_1, contact_2, ch.t - e.mstime AS rel, v
       FROM ev e JOIN pp ON e.type = pp.type JOIN ch ON ch.ses = e.ses AND ch.t BETWEEN e.mstime + lo - buf AND e.mstime + hi + buf),
dm AS (SELECT *, v - avg(v) OVER (PARTITION BY onset_id, period, contact_1, contact_2) AS d FROM ep),
tr AS (SELECT * FROM dm WHERE rel BETWEEN lo AND hi)
""") + """
SELECT onset_id, period, contact_1, contact_2, CAST(NULL AS BIGINT) AS time_bin, round(avg(d), 9) + 0.0 AS value, count(*) AS n
FROM tr WHERE w IS NULL AND rel BETWEEN coalesce(klo, lo) AND coalesce(khi, hi) GROUP BY ALL
UNION ALL
SELECT onset_id, period, contact_1, contact_2, CAST(lo + (ceil((rel - lo) / w) - 1) * w AS BIGINT) AS time_bin, round(avg(d), 9) + 0.0 AS value, count(*) AS n
FROM tr WHERE w IS NOT NULL AND rel > lo GROUP BY ALL"""
