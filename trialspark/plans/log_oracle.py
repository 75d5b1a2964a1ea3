"""Oracle SQL (DuckDB dialect) for ``trialspark.plans.log_queries``: the raw log, every check on its own, the clean log."""

_DAY = 86_400_000

RAW_LOG = f"""
ord AS (SELECT o_custkey AS subject, CAST(year(o_orderdate) AS BIGINT) AS session, o_orderkey AS trial, o_orderstatus AS status,
               CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE o_orderkey + 1 END AS list,
               CASE WHEN year(o_orderdate) % 5 = 0 THEN '' ELSE o_custkey || '_' || year(o_orderdate) END AS eegfile,
               CAST(floor(epoch_us(o_orderdate) / 1000) AS BIGINT) AS mstime FROM orders),
lin AS (SELECT ord.* EXCLUDE (status, mstime), lower(trim(p_brand)) || ' ' || l_partkey AS item, lower(trim(p_type)) AS category,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS serialpos,
               CAST(l_returnflag = 'R' AS BIGINT) AS recalled, CAST(floor(epoch_us(l_shipdate) / 1000) AS BIGINT) AS mstime, l_quantity,
               CASE WHEN round(l_discount, 2) = 0.10 AND round(l_tax, 2) = 0.08 THEN {4000 * _DAY // 1000} ELSE 0 END AS back
        FROM lineitem JOIN ord ON l_orderkey = trial LEFT JOIN part ON l_partkey = p_partkey),
alls AS (SELECT subject, session, trial, list, 'WORD' AS type, item, category, serialpos, recalled, mstime, eegfile, mstime // 1000 - back AS eegoffset FROM lin
  UNION ALL SELECT subject, session, trial, list, 'REC_WORD', item, category, serialpos, recalled, mstime + {3000 * _DAY}, eegfile,
                   mstime // 1000 - back + {3000 * _DAY // 1000} FROM lin WHERE recalled = 1 AND l_quantity < 50
  UNION ALL SELECT subject, session, trial, CASE WHEN status = 'P' THEN NULL ELSE list END, 'REC_START', NULL, NULL, NULL, NULL, mstime, eegfile,
                   mstime // 1000 FROM ord WHERE status IN ('F', 'P')),
rawl AS (SELECT * EXCLUDE (list), CAST(row_number() OVER (ORDER BY subject, session, mstime, type, trial, serialpos NULLS FIRST) - 1 AS BIGINT) AS row_order,
                first_value(list IGNORE NULLS) OVER (PARTITION BY subject, session ORDER BY mstime, type, trial, serialpos NULLS FIRST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS list FROM alls),
x0 AS (SELECT * FROM rawl WHERE list > 0)"""


def _duplicated(flag: str, n: int) -> str:
    return f"""SELECT subject, session, list FROM (SELECT subject, session, list, type FROM ({flag}) GROUP BY ALL HAVING sum(CAST(dup AS BIGINT)) = count(item))
  GROUP BY subject, session, list HAVING count(DISTINCT type) = {n} AND max(CAST(type = 'WORD' AS INT)) = 1"""


_KEYS = "PARTITION BY subject, list, serialpos, item, type"

#: the offenders of every check, by its rule
CHECKS = {
    "missing_types": "SELECT subject FROM x0 WHERE type IN ('WORD', 'REC_WORD') GROUP BY subject HAVING count(DISTINCT type) <> 2",
    "rare_items": """SELECT DISTINCT subject FROM x0 WHERE type = 'WORD' AND item IN (SELECT item FROM x0 WHERE type = 'WORD' GROUP BY item
      HAVING count(DISTINCT subject) < 17)""",
    "repeated": "SELECT subject, session, list FROM w1 GROUP BY subject, session, list HAVING count(item) > count(DISTINCT item)",
    "mismatch": """SELECT w1.subject, w1.session, w1.list FROM w1 LEFT JOIN (SELECT DISTINCT subject, session, list, item, true AS hit FROM x1 WHERE type = 'REC_WORD') r
      ON w1.subject = r.subject AND w1.session = r.session AND w1.list = r.list AND w1.item = r.item WHERE (w1.recalled = 1) <> (hit IS NOT NULL)""",
    "length": "SELECT subject, session, list FROM w1 GROUP BY subject, session, list HAVING count(*) <> 4",
    "timing": f"""SELECT subject, session, list FROM (SELECT *, mstime - lag(mstime) OVER (PARTITION BY subject, session, list ORDER BY row_order) AS g FROM w1)
      WHERE g > {1400 * _DAY} OR g < {2 * _DAY}""",
    "duplicated_encoding": _duplicated(f"SELECT *, count(*) OVER ({_KEYS}) > 1 AS dup FROM x1 WHERE type <> 'REC_START'", 1),
    "duplicated_data": _duplicated(f"SELECT *, row_number() OVER ({_KEYS} ORDER BY row_order) > 1 AS dup FROM x1 WHERE type <> 'REC_START'", 2),
    "offset": """SELECT subject, session, list FROM (SELECT *, eegoffset - lag(eegoffset) OVER (PARTITION BY eegfile ORDER BY row_order) AS d FROM x1
      WHERE type <> 'REC_START' AND eegfile <> '' AND eegoffset <> -1) WHERE d < 0""",
}
_LISTS = [c for c in CHECKS if c not in ("missing_types", "rare_items")]

CLEAN_WORD_LOG = f"""WITH {RAW_LOG},
bs AS ({CHECKS["missing_types"]} UNION {CHECKS["rare_items"]} UNION SELECT unnest([7, 77, 777])),
x1 AS (SELECT * FROM x0 WHERE subject NOT IN (SELECT subject FROM bs)),
w1 AS (SELECT * FROM x1 WHERE type = 'WORD'),
bad AS ({" UNION ".join(f"SELECT subject, session, list FROM ({CHECKS[c]})" for c in _LISTS)}),
x2 AS (SELECT * FROM x1 WHERE (subject, session, list) NOT IN (SELECT (subject, session, list) FROM bad)
       AND (subject, session) IN (SELECT (o_custkey, CAST(year(o_orderdate) AS BIGINT)) FROM orders WHERE o_totalprice > 20000)),
rec AS (SELECT *, row_number() OVER (PARTITION BY subject, session, list, item ORDER BY row_order) > 1 AS recall_repeat,
               CAST(row_number() OVER (PARTITION BY subject, session, list ORDER BY row_order) AS BIGINT) AS outpos FROM x2 WHERE type = 'REC_WORD'),
w2 AS (SELECT x2.*, r.outpos FROM x2 LEFT JOIN (SELECT subject, session, list, item, outpos FROM rec WHERE NOT recall_repeat) r
       ON x2.subject = r.subject AND x2.session = r.session AND x2.list = r.list AND x2.item = r.item WHERE type = 'WORD'),
w3 AS (SELECT *, coalesce(outpos = 1, false) AS first_recalled, lag(item) OVER p AS prev_item, lag(serialpos) OVER p AS prev_serialpos,
              lag(recalled) OVER p AS prev_recalled, lag(outpos) OVER p AS prev_outpos, lag(category) OVER p AS prev_category
       FROM w2 WINDOW p AS (PARTITION BY subject, session, list ORDER BY row_order))
SELECT row_order, subject, session, list, type, item, category, serialpos, recalled, outpos, NULL::BOOLEAN AS recall_repeat, first_recalled,
  prev_item, prev_serialpos, prev_recalled, prev_outpos, prev_category FROM w3
UNION ALL SELECT row_order, subject, session, list, type, item, category, serialpos, recalled, outpos, recall_repeat, NULL, NULL, NULL, NULL, NULL, NULL FROM rec
UNION ALL SELECT row_order, subject, session, list, type, item, category, serialpos, recalled, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM x2
  WHERE type = 'REC_START'"""
