"""Merkle manifest of a dataset: a postorder append log of every tree, and proofs read from it by address.

Rows are leaves (a sha256 over the length-prefixed columns). The leaves of one source, in id order, form a
tree of arity 3 (the last run of a level may be short, even a single node); the trees' tops, in source order,
form the root tree in the same way.

*Order.* Leaves are range-partitioned by (source, id, digest, arrival) and numbered inside a partition; counts
per (source, partition) become offsets, so a leaf's index needs no window over a source. Arrival splits even
one row repeated any number of times.
*Builders.* An aligned builder gets the ``3 ** HEIGHT`` (81) leaves of one block and appends each node when it is
complete, which is postorder; its nodes are one run of the log. Tops of blocks are the leaves of the next
round's builders, each round 81 times smaller.
*Addresses.* A node's place in the log follows from subtree sizes alone (``position``). Proof extraction goes
from the root tree down: a block gets the siblings above it once, finds those inside by address, and hands
them on to its own leaves.

Defined cases: a null column is ``-`` in the leaf; null source is a tree of its own, the first; rows without id
come first in their tree; rows with one id are ordered by digest, and equal rows are leaves of their own; an
empty text is a text of 0 bytes; an empty table gives no rows. Other columns are not read. No group exceeds 81
leaves, however hot a source is.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.staging import arrow_map, small_or_plain, stage
from trialspark.llm.tiles import runs

ARITY, HEIGHT = 3, 4
WIDTH = ARITY ** HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
OUT_ROWS = 4096


def position(level, index, leaves):
    """Place (from 0) of node ``index`` of ``level`` in the postorder log of a tree of ``leaves`` leaves: the
    nodes of all complete subtrees left of it, and its own subtree."""
    level, index = np.asarray(level), np.asarray(index)
    start = index * ARITY ** level
    own = np.minimum(start + ARITY ** level, leaves) - start
    place, size = np.zeros_like(start) - 1, 1
    top = int(level.max(initial=0))
    k = 0
    while k <= top or size <= start.max(initial=0):
        place = place + start // size + np.where(k <= level, -(-own // size), 0)
        k, size = k + 1, size * ARITY
    return place


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while ARITY ** levels < leaves:
        levels += 1
    return levels


def addresses(index: int, leaves: int) -> list[tuple[list[int], list[int]]]:
    """For each level from the leaves up, the log positions of the siblings left and right of the path of leaf
    ``index``."""
    out = []
    for level in range(height(leaves)):
        first, count = index - index % ARITY, -(-leaves // ARITY ** level)
        run = range(first, min(first + ARITY, count))
        out.append(tuple([int(position(level, i, leaves)) for i in run if keep(i, index)]
                         for keep in (int.__lt__, int.__gt__)))
        index //= ARITY
    return out


def parent(hexes) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes over ``leaves`` up to ``levels``, in the order in which they are complete."""
    log: list[str] = []
    pending: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level):
        node = parent(pending[level])
        pending[level].clear()
        pending[level + 1].append(node)
        log.append(node)

    for leaf in leaves:
        log.append(leaf)
        pending[0].append(leaf)
        level = 0
        while level < levels and len(pending[level]) == ARITY:
            close(level)
            level += 1
    for level in range(levels):
        if pending[level]:
            close(level)
    return log


def _hexes(data: bytes) -> list[str]:
    text = data.hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def _levels(n: int) -> int:
    """Levels that the builder of a block climbs, in a tree with ``n`` nodes at the block's lowest level."""
    return min(HEIGHT, height(n))


@lru_cache(maxsize=1024)
def _places(m: int, levels: int) -> list[list[int]]:
    """Local log positions of the nodes of each level of a block of ``m`` leaves."""
    return [position(np.full(c, k), np.arange(c), m).tolist()
            for k in range(levels + 1) for c in (-(-m // ARITY ** k),)]


def _siblings(nodes: list[str], m: int, levels: int) -> list[list[str]]:
    """For each leaf of a block: left and right siblings, by turns, from its own level up to the block's top."""
    sides = []
    for place in _places(m, levels)[:-1]:
        level = []
        for a in range(0, len(place), ARITY):
            run = [nodes[p] for p in place[a:a + ARITY]]
            level += [("".join(run[:i]), "".join(run[i + 1:])) for i in range(len(run))]
        sides.append(level)
    return [[s for k, level in enumerate(sides) for s in level[i // ARITY ** k]] for i in range(m)]


def fold(leaf: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2]):
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


_IDS = "array<struct<id: bigint, changed: binary>>"


def _tasks(rows_of, fields):
    """An Arrow function from ``rows_of`` (batches to tuples), handing on ``OUT_ROWS`` rows at a time."""
    def run(batches):
        held = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), fields)], names=[n for n, _ in fields])
        for row in rows_of(batches):
            held.append(row)
            if len(held) == OUT_ROWS:
                yield batch()
                held = []
        if held:
            yield batch()
    return run


def _each(batches):
    """Rows as dictionaries, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _segments(batches):
    """(tree, block, n, nodes, ids) of every block, from its sorted rows."""
    for t in runs(batches, ("tree", "block")):
        tree, block, n = (t.column(c)[0].as_py() for c in ("tree", "block", "n"))
        nodes = append_log([d.hex() for d in t.column("digest").to_pylist()], _levels(n))
        ids = [{"id": i, "changed": c} for i, c in zip(t.column("id").to_pylist(), t.column("changed").to_pylist())]
        yield tree, block, n, bytes.fromhex("".join(nodes)), ids


def _inside(row):
    """(index, digest, siblings up to the root) of the leaves of a block that knows the siblings above it."""
    nodes, m, levels = _hexes(row["nodes"]), len(row["ids"]), _levels(row["n"])
    for i, own in enumerate(_siblings(nodes, m, levels)):
        yield row["block"] * WIDTH + i, nodes[_places(m, levels)[0][i]], own + row["path"]


def _child_paths(batches):
    for row in _each(batches):
        for index, digest, path in _inside(row):
            yield row["tree"], index, digest, path, row["subroot"], row["root"]


def _proofs(batches):
    for row in _each(batches):
        for (index, leaf, path), x in zip(_inside(row), row["ids"]):
            folded = fold(leaf if x["changed"] is None else x["changed"].hex(), path)
            yield (x["id"], leaf, row["subroot"], row["root"], "".join(path), folded, folded == row["root"], row["tree"], index)


def _log_rows(step):
    """Every node of a round's segments with its place in the whole tree; from the second round on without the
    lowest level, which the round before wrote."""
    def rows(batches):
        for row in _each(batches):
            nodes, m = _hexes(row["nodes"]), len(row["ids"])
            for k, places in enumerate(_places(m, _levels(row["n"]))):
                if k or not step:
                    index = row["block"] * ARITY ** (HEIGHT - k) + np.arange(len(places))
                    at = position(np.full(len(places), step * HEIGHT + k), index, row["leaves"]).tolist()
                    yield from zip([row["tree"]] * len(places), at, [nodes[p] for p in places])
    return rows


_TEXT, _LONG = pa.string(), pa.int64()
SEGMENT = [("tree", _TEXT), ("block", _LONG), ("n", _LONG), ("nodes", pa.binary()),
           ("ids", pa.list_(pa.struct([("id", _LONG), ("changed", pa.binary())])))]
PATH = [("tree", _TEXT), ("index", _LONG), ("digest", _TEXT), ("path", pa.list_(_TEXT)), ("subroot", _TEXT), ("root", _TEXT)]
PROOF = [("id", _LONG), ("leaf", _TEXT), ("subroot", _TEXT), ("root", _TEXT), ("proof", _TEXT), ("folded_root", _TEXT),
         ("verified", pa.bool_()), ("tree", _TEXT), ("index", _LONG)]
LOG = [("tree", _TEXT), ("position", _LONG), ("digest", _TEXT)]
_DDL = {_TEXT: "string", _LONG: "bigint", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(_TEXT): "array<string>",
        SEGMENT[-1][1]: _IDS}


def _map(df: DataFrame, rows_of, fields) -> DataFrame:
    return arrow_map(df, _tasks(rows_of, fields), ", ".join(f"`{n}` {_DDL[t]}" for n, t in fields))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """sha256 (lowercase hex) over the columns in order: ``-`` if null, else byte count, ``:``, value."""
    parts = []
    for c in columns.values():
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Forest:
    """The log of many trees: one staged table of segments (tree, block, n, nodes, ids) for each round."""
    rounds: list[DataFrame] = field(default_factory=list)

    def tops(self) -> DataFrame:
        """(tree, digest) of every tree."""
        found = [r.where(F.col("n") <= WIDTH).select("tree", F.expr("substring(nodes, -32, 32)").alias("digest")) for r in self.rounds]
        return reduce(DataFrame.unionByName, found)

    def log(self) -> DataFrame:
        """Every node: tree, position (postorder, from 0), digest (lowercase hex)."""
        sizes = self.rounds[0].select("tree", F.col("n").alias("leaves")).distinct()
        found = [_map(segments.join(sizes, "tree"), _log_rows(step), LOG) for step, segments in enumerate(self.rounds)]
        return reduce(DataFrame.unionByName, found)

    def with_paths(self, above: DataFrame) -> DataFrame:
        """Lowest segments with the siblings above each block; ``above``: (tree, path, subroot, root)."""
        found = None
        for segments in reversed(self.rounds):
            single = segments.where(F.col("n") <= WIDTH).join(above, "tree")
            if found is not None:
                down = stage(_map(found, _child_paths, PATH), "paths").drop("digest").withColumnRenamed("index", "block")
                single = single.unionByName(segments.where(F.col("n") > WIDTH).join(down, ["tree", "block"]))
            found = single
        return found


def ordered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, ...) with their index in the tree by ``order`` and the tree's size n, without a window
    over a tree: range partitions, an index inside each, and offsets from counts."""
    arrived = stage(leaves.withColumn("arrival", F.monotonically_increasing_id()), "leaves")
    by = ["tree", *order, "arrival"]
    dealt = stage(arrived.repartitionByRange(*by).sortWithinPartitions(*by).drop("arrival")
                  .withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = dealt.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stage(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")), "offsets")
    return (dealt.withColumn("part", part).join(small_or_plain(offsets, 256), ["tree", "part"])
            .withColumn("index", F.col("at") + F.col("shift")).drop("part", "shift", "at"))


def no_row() -> list[Column]:
    """For inner nodes, which stand for no row."""
    return [F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("changed")]


def build(leaves: DataFrame) -> Forest:
    """The log over ``leaves`` (tree, index, n, digest, id, changed), in rounds of aligned builders."""
    forest, level = Forest(), leaves
    while True:
        rows = (level.withColumn("block", F.expr(f"index div {WIDTH}")).select("tree", "block", "index", "n", "digest", "id", "changed")
                .repartition("tree", "block").sortWithinPartitions("tree", "block", "index"))
        segments = stage(_map(rows, _segments, SEGMENT), "segments")
        forest.rounds.append(segments)
        wide = segments.where(F.col("n") > WIDTH)
        if wide.isEmpty():
            return forest
        level = wide.select("tree", F.col("block").alias("index"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"),
                            F.expr("substring(nodes, -32, 32)").alias("digest"), *no_row())


def manifest(docs: DataFrame, changed: Column | None = None, columns=COLUMNS, id_col: str = "doc_id",
             group_col: str = "source", text_col: str = "text") -> tuple[DataFrame, Forest, Forest]:
    """One row per row of ``docs`` (id, leaf, subroot, root, proof, folded_root, verified, tree, index), the log of
    the groups' trees and that of the root tree. ``proof`` holds the siblings from the leaf to the root, left to
    right, joined. ``changed`` is the text from which a leaf is folded to the root again, null where the text
    stands."""
    cols = {c: F.col(c) for c in columns}
    other = F.lit(None).cast("binary")
    if changed is not None:
        other = F.when(changed.isNotNull(), F.unhex(leaf_digest(cols | {text_col: changed})))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"),
                         F.unhex(leaf_digest(cols)).alias("digest"), other.alias("changed"))
    groups = build(ordered(leaves, ["id", "digest"]))
    tops = stage(ordered(groups.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]), "tops")
    whole = build(tops.select("tree", "index", "n", "digest", *no_row()))
    root = whole.tops().select("tree", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"),
                               F.lower(F.hex("digest")).alias("root"))
    found = stage(_map(whole.with_paths(root), _child_paths, PATH), "paths")
    above = found.join(tops.select("index", "name"), "index").select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return _map(groups.with_paths(above), _proofs, PROOF), groups, whole
