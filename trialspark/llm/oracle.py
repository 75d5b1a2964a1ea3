"""DuckDB SQL for the queries that SQL can express over whole tables."""

LOWER = "translate(coalesce({0},''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
NONSPACE = r"regexp_extract_all(" + LOWER + r", '[^\x20\x09-\x0D]+')"

#: connected components: smallest id reachable over links(a, b)
COMPONENTS = """reach(id, r) AS (
  SELECT id, id FROM node
  UNION SELECT l.b, r FROM reach JOIN (SELECT a, b FROM link UNION SELECT b, a FROM link) l ON l.a = reach.id
), comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""


def decontamination(documents: str = "documents") -> str:
    """CTE ``leak`` (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items)."""
    return f"""
d AS (SELECT doc_id, {ALNUM.format('text')} AS w FROM {documents}),
i AS (SELECT item_id, {ALNUM.format('text')} AS w FROM benchmark),
win AS (SELECT item_id, L, list_slice(w, s, s + L - 1) AS g FROM
  (SELECT item_id, w, least(len(w), 10) AS L, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
   FROM i WHERE len(w) > 0)),
occ AS (SELECT doc_id, s, L, array_to_string(list_slice(w, s, s + L - 1), ' ') AS g FROM
  (SELECT doc_id, w, L, unnest(range(1, len(w) - L + 2)) AS s
   FROM d CROSS JOIN (SELECT DISTINCT L FROM win) WHERE len(w) >= L)),
hit AS (SELECT DISTINCT doc_id, s, occ.L, item_id FROM occ
  JOIN (SELECT DISTINCT item_id, L, array_to_string(g, ' ') AS g FROM win) x USING (g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
  (SELECT doc_id, unnest(range(s, s + L)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM hit GROUP BY doc_id),
gap AS (SELECT item_id, k, array_to_string(list_concat(list_concat(list_slice(g, 1, k - 1), ['*']),
    list_slice(g, k + 1, 10)), ' ') AS g
  FROM (SELECT item_id, g, unnest(range(1, 11)) AS k FROM win WHERE L = 10)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM (
  SELECT doc_id, item_id FROM hit
  UNION SELECT doc_id, item_id FROM (
    SELECT doc_id, array_to_string(list_concat(list_concat(list_slice(w, s, s + k - 2), ['*']),
      list_slice(w, s + k, s + 9)), ' ') AS g
    FROM (SELECT doc_id, w, s, unnest(range(1, 11)) AS k FROM
      (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS s
       FROM (SELECT doc_id, list_concat(list_concat([''], w), ['']) AS w FROM d))))
    JOIN gap USING (g)) GROUP BY doc_id),
leak AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id))"""


OP6 = f"WITH {decontamination()} SELECT * FROM leak"


def near_classes(k: int, documents: str = "documents") -> str:
    """CTEs up to ``comp`` (id, component_id) over documents with equal-or-near shingle sets;
    ``sets`` has doc_id and the distinct k-word shingles s."""
    return f"""
words AS (SELECT doc_id, {NONSPACE.format('text')} AS w FROM {documents}),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda p: array_to_string(list_slice(w, p, p + {k - 1}), ' ')))
  END AS s FROM words),
shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id < y.doc_id
  AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
node AS (SELECT doc_id AS id FROM {documents}),
{COMPONENTS}"""


OP3 = f"""WITH RECURSIVE {near_classes(2)}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept
FROM sets JOIN comp ON id = doc_id"""


OP5 = f"""WITH d AS (SELECT doc_id, source, CAST(len({NONSPACE.format('text')}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
  [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER past, 0.0::DOUBLE))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER past, 0.0::DOUBLE)) AS level FROM w
  WINDOW past AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT first(level ORDER BY cap / weight, source NULLS LAST) AS final FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, coalesce(least(cap, final * weight), cap) AS target FROM l, f),
a AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source
  ORDER BY md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d)
SELECT doc_id, size, source_size, target,
  CAST(greatest(least(round(target) - ahead, size), 0) + greatest(least(round(target) - source_size - ahead, size), 0)
  AS BIGINT) AS taken
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source"""


def line_dedup(documents: str = "documents", distance: int = 2, min_chars: int = 20) -> str:
    """CTEs up to ``clean`` (doc_id, n_lines, n_dropped, text): the first line of every class stays.
    Lines within the distance have counts of any letter that differ by no more than it."""
    some = "etaonir"
    letters = ", ".join(f"length(line) - length(replace(line, '{c}', '')) AS c{c}" for c in some)
    close = " AND ".join(f"abs(x.c{c} - y.c{c}) <= {distance}" for c in some)
    return f"""
o AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents} WHERE doc_id IS NOT NULL),
li AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM o),
el AS (SELECT * FROM li WHERE length(line) >= {min_chars}),
ids AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM el)),
sized AS (SELECT id, line, length(line) AS n, {letters} FROM ids),
link AS (SELECT x.id AS a, y.id AS b FROM sized x JOIN sized y ON x.id < y.id
  AND y.n BETWEEN x.n - {distance} AND x.n + {distance} AND {close} AND levenshtein(x.line, y.line) <= {distance}),
node AS (SELECT id FROM ids WHERE id IN (SELECT a FROM link UNION SELECT b FROM link)),
{COMPONENTS},
cls AS (SELECT doc_id, pos, coalesce(component_id, ids.id) AS c FROM el JOIN ids USING (line) LEFT JOIN comp ON comp.id = ids.id),
gone AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, pos) AS r FROM cls) WHERE r > 1),
clean AS (SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  coalesce(g.n, 0) AS n_dropped, CASE WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
  FROM {documents} d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM li ANTI JOIN gone USING (doc_id, pos)
    GROUP BY doc_id) k USING (doc_id))"""


OP9 = f"""WITH RECURSIVE {line_dedup()}
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
  sha256(coalesce(text, '')) AS text_sha256 FROM clean"""


OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  AND list_cosine_similarity(x.e, y.e) >= 0.9),
node AS (SELECT vec_id AS id FROM embeddings),
{COMPONENTS},
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM link UNION ALL SELECT b FROM link) GROUP BY id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = vec_id AS kept
FROM v JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.id = vec_id"""


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256({})".format(" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
_CRC = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length({0}) + 1), "
        "lambda i: list_prepend(CAST(ascii(substr({0}, i, 1)) AS BIGINT), [CAST(-1 AS BIGINT) for k in range(8)])))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END), CAST(4294967295 AS BIGINT))")
_RUNS = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))"


def merkle(documents: str = "documents") -> str:
    """CTEs up to ``proof``: levels of every tree as lists (tree 0 is the root tree, the others are numbered in
    source order), the siblings of every leaf and the fold of its tampered form."""
    return f"""
leaf AS (SELECT doc_id, source, {_LEAF} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0
    THEN {_LEAF.replace("(text ", "(replace(text, chr(10), '') ").replace("CAST(text ", "CAST(replace(text, chr(10), '') ")} END AS tampered FROM {documents}),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
level AS (SELECT tree, 0 AS h, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY tree
  UNION ALL SELECT tree, h + 1, {_RUNS} FROM level WHERE len(nodes) > 1),
top AS (SELECT tree, nodes[1] AS subroot FROM level WHERE len(nodes) = 1),
whole AS (SELECT 0 AS h, (SELECT list(subroot ORDER BY tree) FROM top) AS nodes
  UNION ALL SELECT h + 1, {_RUNS} FROM whole WHERE len(nodes) > 1),
step AS (SELECT tree, h, nodes, 0 AS part FROM level WHERE len(nodes) > 1),
row_at AS (SELECT row_number() OVER () AS r, placed.*, (SELECT max(h) FROM level WHERE level.tree = placed.tree) AS top_h FROM placed),
up AS (SELECT r, tree, h, i // CAST(pow(3, h) AS BIGINT) AS j, nodes FROM row_at JOIN step USING (tree)
  UNION ALL SELECT r, tree, top_h + w.h, (tree - 1) // CAST(pow(3, w.h) AS BIGINT), w.nodes
  FROM row_at CROSS JOIN (SELECT * FROM whole WHERE len(nodes) > 1) w),
side AS (SELECT r, h, array_to_string(nodes[3 * (j // 3) + 1:j], '') AS l, array_to_string(nodes[j + 2:3 * (j // 3) + 3], '') AS rt FROM up),
proof AS (SELECT r, string_agg(l || rt, '' ORDER BY h) AS proof, list(l ORDER BY h) AS ls, list(rt ORDER BY h) AS rs FROM side GROUP BY r),
full_row AS (SELECT row_at.*, top.subroot, (SELECT nodes[1] FROM whole WHERE len(nodes) = 1) AS root, coalesce(proof, '') AS proof,
  coalesce(ls, []) AS ls, coalesce(rs, []) AS rs FROM row_at JOIN top USING (tree) LEFT JOIN proof USING (r)),
fold AS (SELECT r, 0 AS h, coalesce(tampered, leaf) AS d, ls, rs FROM full_row
  UNION ALL SELECT r, h + 1, sha256(ls[h + 1] || d || rs[h + 1]), ls, rs FROM fold WHERE h < len(ls))"""


OP11 = f"""WITH RECURSIVE {merkle()}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified
FROM full_row JOIN fold USING (r) WHERE fold.h = len(fold.ls)"""


OP13 = """WITH ok AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM ok a JOIN ok b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
