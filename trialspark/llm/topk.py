"""Exact top-k by integer inner product, with the three-phase uniform threshold method.

The components are cut into ``lists`` score lists: a vector's score for a query is the sum of one partial score
from each list. Lists are held in tiles (list, query block, candidate block), so a task knows one list's partial
scores of one block pair and nothing else.

1. *Gather.* Every tile reports the best ``k + 1`` entries of each query, of which each list keeps the best
   ``gathered``; the missing partial scores of these candidates are asked for, and the (k+1)-th best exact score
   is the query's cutoff. Any candidates give a safe cutoff; more of them give a higher one.
2. *Collect.* The cutoff goes to all tiles. A candidate that reaches it has at least ``cutoff / lists`` in some
   list, so each list reports the entries from there on. Ties count by id: a larger id than the cutoff's must
   score more.
3. *Resolve.* Collected candidates whose upper bound (unknown lists stay under the threshold) reaches the cutoff
   get their missing partial scores; the best by score, then id, are the answer.

Equal vectors are one candidate with their ``k + 1`` smallest ids, and equal queries are asked once, so a vector
that a third of all rows repeat costs no more than any other. k + 1 distinct vectors are enough: at most one of
their rows is the query's own. Every query meets every vector, but in blocks and as matrix products; what is
written are the entries over the threshold.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part;
only vectors of one length meet; an empty vector scores 0 with another; a row repeated with its id counts once;
a component beyond 2^31 / sqrt(length) counts as that, which keeps every score in a long. An empty table, or one
without queries, gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.staging import arrow_map, stage
from trialspark.llm.tiles import runs

LISTS, GATHERED, QUERIES, ROWS, CHUNK = 2, 48, 4096, 4096, 256
KEYS = ["dim", "list", "qb", "cb"]
CANDIDATE, QUERY, ASK = 0, 1, 2


# -- tiles -----------------------------------------------------------------------------------------

def _parts(rows: pa.Table) -> np.ndarray:
    column = rows.column("part").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column.flatten()) else np.zeros((len(column), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs, by the fast product where doubles hold them."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 2 ** 53 else a @ b.T


def _tiles(batches):
    """(list, queries, candidates, their parts, asked pairs) of every tile; candidates by falling priority."""
    for t in runs(batches, KEYS):
        kind = t.column("kind").to_numpy()
        q, c, asks = (t.filter(pa.array(kind == k)) for k in (QUERY, CANDIDATE, ASK))
        if not q.num_rows or not c.num_rows:
            continue
        c = c.take(pa.array(np.argsort(c.column("low").to_numpy(), kind="stable")))
        yield t.column("list")[0].as_py(), q, c, _parts(q), _parts(c), asks


def _entries(part, q, c, found, score):
    row, col = np.nonzero(found)
    return pa.RecordBatch.from_arrays(
        [pa.array(q[row]), pa.array(c[col]), pa.array(np.full(len(row), part, np.int32)), pa.array(score[row, col])],
        names=["q", "c", "list", "partial"])


def _gather(wanted):
    """The ``wanted`` best entries of every query in a tile, ties by id."""
    def run(batches):
        for part, q, c, qx, cx, _ in _tiles(batches):
            qn, cn = q.column("node").to_numpy(), c.column("node").to_numpy()
            k = min(wanted, len(cn))
            for a in range(0, len(qn), CHUNK):
                s = products(qx[a:a + CHUNK], cx)
                last = np.partition(s, len(cn) - k, axis=1)[:, len(cn) - k, None]
                more, tied = s > last, s == last
                found = more | tied & (tied.cumsum(axis=1) <= k - more.sum(axis=1, keepdims=True))
                yield _entries(part, qn[a:a + CHUNK], cn, found, s)
    return run


def _collect(lists):
    """All entries of a tile that reach the uniform threshold of their query."""
    def run(batches):
        for part, q, c, qx, cx, _ in _tiles(batches):
            qn, cn, low = q.column("node").to_numpy(), c.column("node").to_numpy(), c.column("low").to_numpy()
            cut = q.column("cut").fill_null(-2 ** 62).to_numpy()
            cut_low = q.column("cut_low").fill_null(2 ** 62).to_numpy()
            for a in range(0, len(qn), CHUNK):
                s = products(qx[a:a + CHUNK], cx)
                need = cut[a:a + CHUNK, None] + (low[None, :] > cut_low[a:a + CHUNK, None])
                yield _entries(part, qn[a:a + CHUNK], cn, s >= -(-need // lists), s)
    return run


def _answer(batches):
    """The partial scores of the asked pairs."""
    for part, q, c, qx, cx, asks in _tiles(batches):
        qn, cn = q.column("node").to_numpy(), c.column("node").to_numpy()
        qo, co = np.argsort(qn), np.argsort(cn)
        i = qo[np.searchsorted(qn[qo], asks.column("node").to_numpy())]
        j = co[np.searchsorted(cn[co], asks.column("other").to_numpy())]
        wide = float(np.abs(qx).max(initial=0)) * float(np.abs(cx).max(initial=0)) * qx.shape[1] >= 2 ** 62
        for a in range(0, len(i), 8192):
            x, y = qx[i[a:a + 8192]], cx[j[a:a + 8192]]
            s = (x.astype(object) * y).sum(axis=1).astype(np.int64) if wide else (x * y).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [asks.column("node").slice(a, 8192).combine_chunks(), asks.column("other").slice(a, 8192).combine_chunks(),
                 pa.array(np.full(len(s), part, np.int32)), pa.array(s.astype(np.int64))], names=["q", "c", "list", "partial"])


_ENTRY = "q bigint, c bigint, list int, partial bigint"


class Lists:
    """Score lists of ``nodes`` (node, low, dim, x) for the ``queries`` among them, dealt in tiles."""

    def __init__(self, nodes: DataFrame, queries: DataFrame, lists: int, query_block: int, row_block: int):
        self.nodes, self.queries, self.lists = nodes, queries, lists
        self.query_blocks = max(1, -(-queries.count() // query_block))
        self.row_blocks = max(1, -(-nodes.count() // row_block))

    def _block(self, node: str, blocks: int):
        return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")

    def _side(self, rows: DataFrame, kind: int):
        """``rows`` once for each list and block of the other side, with their components of that list."""
        own, other = ("qb", "cb") if kind == QUERY else ("cb", "qb")
        own_n, other_n = (self.query_blocks, self.row_blocks) if kind == QUERY else (self.row_blocks, self.query_blocks)
        first = F.expr(f"list * dim div {self.lists}")
        size = F.expr(f"(list + 1) * dim div {self.lists}") - first
        return (rows.withColumn(own, self._block("node", own_n)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
                .withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(self.lists - 1))))
                .select(*KEYS, F.lit(kind).alias("kind"), "node", "low", F.lit(None).cast("long").alias("other"),
                        F.slice("x", (first + 1).cast("int"), size.cast("int")).alias("part"), "cut", "cut_low"))

    def _run(self, function, queries: DataFrame, asks: DataFrame | None = None) -> DataFrame:
        no_cut = {"cut": F.lit(None).cast("long"), "cut_low": F.lit(None).cast("long")}
        sides = [self._side(self.nodes.withColumns(no_cut), CANDIDATE),
                 self._side(queries if "cut" in queries.columns else queries.withColumns(no_cut), QUERY)]
        if asks is not None:
            sides.append(asks.withColumn("qb", self._block("q", self.query_blocks)).withColumn("cb", self._block("c", self.row_blocks))
                         .select(*KEYS, F.lit(ASK).alias("kind"), F.col("q").alias("node"), F.lit(0).cast("long").alias("low"),
                                 F.col("c").alias("other"), F.array().cast("array<bigint>").alias("part"), *[c.alias(n) for n, c in no_cut.items()]))
        dealt = reduce(DataFrame.unionByName, sides).repartition(*KEYS).sortWithinPartitions(*KEYS)
        return arrow_map(dealt, function, _ENTRY)

    def gather(self, wanted: int, keep: int) -> DataFrame:
        """Phase 1: the ``keep`` best entries (q, c, list, partial) of every list and query, out of ``wanted`` from each
        of its tiles."""
        local = self._run(_gather(wanted), self.queries).join(self.nodes.select(F.col("node").alias("c"), "low"), "c")
        best = Window.partitionBy("q", "list").orderBy(F.desc("partial"), "low")
        return local.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep).select("q", "c", "list", "partial")

    def collect(self, cutoffs: DataFrame) -> DataFrame:
        """Phase 2: all entries over the uniform threshold; ``cutoffs``: (q, cut, cut_low)."""
        queries = self.queries.join(cutoffs.withColumnRenamed("q", "node"), "node", "left")
        return self._run(_collect(self.lists), queries)

    def resolve(self, entries: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
        """(q, c, low, score) of the entries' pairs, with the partial scores that are missing; by ``cutoffs``,
        pairs that cannot reach them are left out."""
        low = self.nodes.select(F.col("node").alias("c"), "low", "dim")
        pairs = entries.groupBy("q", "c").agg(F.sum("partial").alias("known"), F.array_sort(F.collect_list("list")).alias("have")).join(low, "c")
        if cutoffs is not None:
            need = F.col("cut") + (F.col("low") > F.col("cut_low")).cast("int")
            most = F.col("known") + (self.lists - F.size("have")) * F.floor((need - 1) / self.lists)
            pairs = pairs.join(cutoffs, "q", "left").where(F.coalesce(most >= need, F.lit(True))).drop("cut", "cut_low")
        pairs = stage(pairs, "pairs")
        every = F.sequence(F.lit(0), F.lit(self.lists - 1))
        asks = pairs.select("q", "c", "dim", F.explode(F.array_except(every, "have")).alias("list"))
        answers = self._run(_answer, self.queries, asks).groupBy("q", "c").agg(F.sum("partial").alias("more"))
        return pairs.join(answers, ["q", "c"], "left").select("q", "c", "low", (F.col("known") + F.coalesce("more", F.lit(0))).alias("score"))


# -- search ----------------------------------------------------------------------------------------

def _best(scores: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)


def top_k(vectors: DataFrame, is_query, k: int = 5, lists: int = LISTS, gathered: int = GATHERED,
          query_block: int = QUERIES, row_block: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of ``vectors`` (vec_id, embedding) for every row
    where ``is_query`` (a column over vec_id) holds."""
    wide = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(wide, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    limit = F.floor(F.lit(2.0 ** 31) / F.sqrt(F.greatest(F.size("embedding"), F.lit(1)).cast("double")))
    x = F.transform(wide, lambda v: F.greatest(F.least(F.floor(v * 256.0), limit), -limit))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = stage(rows.select("vec_id", "x", F.xxhash64("x").alias("f1"), F.xxhash64(F.lit(1), "x").alias("f2")), "vectors")

    # equal vectors: one node with its smallest ids
    ids = rows.select("f1", "f2", "vec_id").distinct()
    least = Window.partitionBy("f1", "f2").orderBy("vec_id")
    same = stage(ids.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
                 .groupBy("f1", "f2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                 .withColumn("low", F.col("ids")[0]).withColumn("node", F.monotonically_increasing_id()), "same")
    nodes = stage(rows.join(same.select("f1", "f2", "node", "low", F.col("low").alias("vec_id")), ["f1", "f2", "vec_id"])
                  .groupBy("node", "low").agg(F.first("x").alias("x")).withColumn("dim", F.size("x")), "nodes")
    asked = stage(rows.where(is_query).select("f1", "f2", "vec_id").distinct().join(same.select("f1", "f2", "node"), ["f1", "f2"])
                  .select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "queries")
    queries = stage(nodes.join(asked.select(F.col("q").alias("node")).distinct(), "node", "left_semi"), "query_nodes")

    held = Lists(nodes, queries, lists, query_block, row_block)
    first = stage(held.gather(k + 1, max(k + 1, gathered)), "gathered")
    cutoffs = stage(_best(held.resolve(first), k + 1).where(F.col("place") == k + 1)
                    .select("q", F.col("score").alias("cut"), F.col("low").alias("cut_low")), "cutoffs")
    entries = stage(held.collect(cutoffs), "collected")
    best = stage(_best(held.resolve(entries, cutoffs), k + 1).select("q", "c", "score"), "best")

    found = (asked.join(best, "q").join(same.select(F.col("node").alias("c"), "ids"), "c")
             .select("query_id", "q", "c", "score", F.explode("ids").alias("vec_id"))
             .where((F.col("q") != F.col("c")) | (F.col("vec_id") != F.col("query_id"))))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
