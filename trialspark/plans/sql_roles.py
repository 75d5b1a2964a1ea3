"""The role mapping of ``trialspark.sources.roles`` written as SQL common table expressions.

These are used by the independent SQL oracle (DuckDB dialect) that checks each
Spark query; they must state the same mapping as the DataFrame code.
"""

WORDS_NO_CAT = """
words AS (
  SELECT o.o_custkey AS subject,
         CAST(year(o.o_orderdate) AS BIGINT) AS session,
         l.l_orderkey AS list,
         CAST(row_number() OVER (PARTITION BY l.l_orderkey
              ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate) AS BIGINT)
           AS serialpos,
         l.l_partkey AS item,
         CAST(l.l_returnflag = 'R' AS BIGINT) AS recalled,
         l.l_extendedprice AS value,
         CAST(floor(epoch_us(l.l_shipdate) / 1000) AS BIGINT) AS mstime,
         l.l_linestatus AS status,
         CAST(o.o_orderpriority = '1-URGENT' AS BIGINT) AS urgent
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

WORDS = WORDS_NO_CAT.replace("words AS (", "words_nc AS (") + """,
words AS (
  SELECT w.*, p.p_type AS category FROM words_nc w LEFT JOIN part p ON w.item = p.p_partkey
)"""

EVENTS = """
evlog AS (
  SELECT event_id,
         user_id AS subject,
         CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS session,
         CAST(floor(hour(ts) / 6) + 1 AS BIGINT) AS list,
         event_type AS type,
         CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS mstime,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
         value
  FROM events
)"""

# feature events: vectors in lists of 12, 8 lists per session, 2 sessions per subject
FEATURES = """
fev AS (
  SELECT vec_id AS event,
         CAST(floor(vec_id / 192) AS BIGINT) AS subject,
         CAST(floor(vec_id / 96) AS BIGINT) AS session,
         CAST(floor(vec_id / 12) AS BIGINT) AS list,
         vec_id % 12 + 1 AS serialpos,
         CAST(label AS BIGINT) AS category,
         label = 0 AS is_baseline,
         embedding
  FROM embeddings
),
flong AS (
  SELECT f.event, f.subject, f.session, f.list, f.serialpos, f.category, f.is_baseline,
         CAST(u.k - 1 AS BIGINT) AS k,
         CAST(f.embedding[u.k] AS DOUBLE) AS x
  FROM fev f, LATERAL (SELECT unnest(range(1, len(f.embedding) + 1)) AS k) u
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
