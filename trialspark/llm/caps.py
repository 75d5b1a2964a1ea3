"""Near-duplicate vectors with spherical-cap filters.

Filter directions are structured: a random rotation splits a unit vector into two blocks, each block
has a code of ``code`` random unit vectors, and every pair of code words is a direction. A vector
passes a direction if its inner product with it reaches the cap's threshold; since that product is
the sum of two block products, list decoding finds all directions that a vector passes from two
sorted lists, without trying all pairs. ``repeats`` independent codes are used. Vectors that share a
filter are compared; pairs at or above the cosine are links.

First every vector is sent to its filters as a byte per component, and pairs that could reach the
cosine, by the rounding bound, mark their vectors. Only marked vectors are then sent with double
components and their list of filters. A pair is counted in the first filter that both pass, so a
group of k near copies is counted where it is, as sums and a spanning forest, and no pair leaves a
task. Filters with more than ``tile`` vectors are cut into pairs of tiles, dealt over tasks.

From 16 components on, the threshold is set so that a random unit vector passes about ``passes``
filters; a pair at cosine 0.9 then shares one with probability 0.99. Shorter vectors have a smaller
code and a threshold measured on pairs at the cosine (see ``Filters``). The method is approximate
below certainty; a test measures recall against brute force at lengths from 1 to 384. Links are
never false.

Defined cases: a vector that is null, zero, or has a null or non-finite component links with nothing,
as does one whose vec_id is null; vectors of different length do not link; equal vectors are one
node with copies; rows with one vec_id and one vector count once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.components import connected_components, forest
from trialspark.llm.staging import arrow_map, small_or_plain, stage, unstage
from trialspark.llm.tiles import answerable, groups, tiled

CODE, REPEATS, PASSES, TILE = 400, 7, 64, 1500
SMALL, SMALL_CODE, RING = 16, 64, 8


def _words(dim: int, code: int, rng) -> np.ndarray:
    """The code words of a block as columns: both directions, a ring, or random unit vectors."""
    if dim == 0:
        return np.zeros((0, 1))
    if dim == 1:
        return np.array([[1.0, -1.0]])
    if dim == 2 and code <= SMALL_CODE:
        turn = 2 * np.pi * np.arange(RING) / RING
        return np.stack([np.cos(turn), np.sin(turn)])
    w = rng.normal(size=(dim, code))
    return w / np.linalg.norm(w, axis=0)


class Filters:
    """Codes and threshold for one dimension. From ``SMALL`` components on, the blocks of a random vector have
    about equal norms, and the threshold follows from ``passes``. Below, they have not: there a smaller code is
    used, and the threshold is the largest at which 99.5 % of random pairs at ``cosine`` share a filter."""

    def __init__(self, dim: int, code: int, repeats: int, passes: int, cosine: float):
        small = dim < SMALL
        code = min(code, SMALL_CODE) if small else code
        self.parts, half = [], max(1, dim // 2)
        for r in range(repeats if dim > 1 else 1):
            rng = np.random.default_rng([dim, r])
            q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            left, right = _words(half, code, rng), _words(dim - half, code, rng)
            scale = np.sqrt(2) if dim > 1 else 1.0
            self.parts.append((q[:, :half] @ left / scale, q[:, half:] @ right / scale))
        self.code = max(left.shape[1], right.shape[1])
        probe = np.random.default_rng([dim, 99]).normal(size=(1000 if small else 64, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        if not small:
            a, b = probe @ self.parts[0][0], probe @ self.parts[0][1]
            self.threshold = np.quantile((a[:, :, None] + b[:, None, :]).ravel(), 1 - passes / repeats / code ** 2)
            return
        turn = np.random.default_rng([dim, 98]).normal(size=probe.shape)
        turn -= (turn * probe).sum(axis=1, keepdims=True) * probe
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
        other = cosine * probe + np.sqrt(1 - cosine ** 2) * turn if dim > 1 else probe
        shared = np.full(len(probe), -1.0)
        for a, b in self.parts:
            for i in range(0, len(probe), 50):
                both = np.minimum(*[((x @ a)[:, :, None] + (x @ b)[:, None, :]) for x in (probe[i:i + 50], other[i:i + 50])])
                shared[i:i + 50] = np.maximum(shared[i:i + 50], both.max(axis=(1, 2)))
        self.threshold = np.quantile(shared, 0.005) - 1e-9

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the unit rows of ``x`` pass, by row, then filter."""
        rows, found = [], []
        for r, (left, right) in enumerate(self.parts):
            a, b = x @ left, x @ right
            order = np.argsort(-b, axis=1)
            b = np.take_along_axis(b, order, axis=1)
            need = self.threshold - a
            row, i = np.nonzero(need <= b[:, :1])
            # one search over all rows: products lie within -1 and 1, rows are 4 apart
            line = (4.0 * np.arange(len(x))[:, None] - b).ravel()
            n = np.searchsorted(line, 4.0 * row - need[row, i], "right") - row * b.shape[1]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, i = np.repeat(row, n), np.repeat(i, n)
            rows.append(row)
            found.append((r * self.code + i) * self.code + order[row, k])
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        return rows[order], found[order]


@lru_cache(maxsize=8)
def filters(dim: int, code: int, repeats: int, passes: int, cosine: float) -> Filters:
    return Filters(dim, code, repeats, passes, cosine)


def _unit(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a list column, by dimension."""
    off = column.offsets.to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    off = off - off[0]
    dims = np.diff(off)
    out = []
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        x = flat[off[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def _key(dim: int, found: np.ndarray) -> np.ndarray:
    return (np.int64(dim) << 40) + found


def _coarse(args):
    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            for a in range(0, batch.num_rows, 512):
                for rows, x in _unit(batch.column(1).slice(a, 512)):
                    row, found = filters(x.shape[1], *args).decode(x)
                    step = np.abs(x).max(axis=1, keepdims=True) / 127
                    q = np.rint(x / step).astype(np.int8)
                    packed = np.concatenate([step.astype(np.float32).view(np.int8), q], axis=1)
                    data = packed[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_key(x.shape[1], found)), pa.array(node[a + rows[row]]), _binary(data)],
                        names=["key", "node", "v"])
    return run


def _exact(args):
    def run(batches):
        for batch in batches:
            node, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a in range(0, batch.num_rows, 256):
                for rows, x in _unit(batch.column(1).slice(a, 256)):
                    row, found = filters(x.shape[1], *args).decode(x)
                    n = np.bincount(row, minlength=len(rows))
                    at = np.cumsum(n) - n
                    keys = _key(x.shape[1], found)
                    heads = np.stack([copies[a + rows], np.full(len(rows), x.shape[1])], axis=1).astype(np.float64)
                    values = [np.concatenate([heads[i], x[i]]).tobytes() + keys[at[i]:at[i] + n[i]].tobytes()
                              for i in range(len(rows))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(node[a + rows[row]]), pa.array([values[i] for i in row], pa.binary())],
                        names=["key", "node", "v"])
    return run


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)),
                                                  pa.py_buffer(np.ascontiguousarray(rows))])


def _mark(cosine: float):
    def run(batches):
        for (key, i, j), rows in groups(batches):
            values = rows.column("v").to_pylist()
            raw = np.frombuffer(b"".join(values), dtype=np.int8).reshape(len(values), -1)
            step = raw[:, :4].copy().view(np.float32).astype(np.float64)
            q = raw[:, 4:].astype(np.float64) * step
            # rounding moves a vector by at most half a step in every component
            err = step[:, 0] * 0.501 * np.sqrt(q.shape[1])
            near = q @ q.T >= cosine - err[:, None] * 1.01 - err[None, :] * 1.01 - err[:, None] * err[None, :]
            near = answerable(near, rows, i, j)
            node = rows.column("node").to_numpy()
            hit = np.unique(node[near.any(axis=1)])
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(hit)], names=["node"])
    return run


def _link(cosine: float):
    def run(batches):
        for (key, i, j), rows in groups(batches):
            values = rows.column("v").to_pylist()
            dim = int(np.frombuffer(values[0], np.float64, 1, 8)[0])
            head = np.stack([np.frombuffer(v, np.float64, dim + 2) for v in values])
            copies, x = head[:, 0].astype(np.int64), head[:, 2:]
            near = answerable(x @ x.T >= cosine, rows, i, j)
            if not near.any():
                continue
            node = rows.column("node").to_numpy()
            # pairs that share an earlier filter are counted there
            lists = [np.frombuffer(v, np.int64, -1, 8 * (dim + 2)) for v in values]
            early = [v[v < key] for v in lists]
            own, place = np.unique(np.concatenate(early), return_inverse=True)
            has = np.zeros((len(values), len(own) + 1), dtype=np.float32)
            has[np.repeat(np.arange(len(values)), [len(v) for v in early]), place] = 1
            first = near & (has @ has.T == 0)
            n = (first @ copies).astype(np.int64)
            a, b = np.nonzero(near)
            u, v = forest(node[a], node[b])
            for kind, u, v in ((0, node[n > 0], n[n > 0]), (1, u, v)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v)],
                                                 names=["kind", "u", "v"])
    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, code: int = CODE, repeats: int = REPEATS,
                 passes: int = PASSES, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
             & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding",
                          F.coalesce(sound, F.lit(False)).alias("sound"),
                          F.xxhash64("embedding").alias("f1"), F.hash("embedding").alias("f2"))
    good = rows.where("sound").select("vec_id", x.alias("x"), "f1", "f2")
    ids = stage(good.groupBy("f1", "f2").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies")), "vector_ids")
    nodes = stage(good.join(ids.withColumnRenamed("node", "vec_id"), ["vec_id", "f1", "f2"])
                  .select(F.col("vec_id").alias("node"), "x", "copies"), "vectors")
    args = (code, repeats, passes, cosine)
    coarse = stage(arrow_map(nodes.select("node", "x"), _coarse(args), "key long, node long, v binary"), "filters")
    marked = stage(arrow_map(tiled(coarse, coarse, tile, ["v"]), _mark(cosine), "node long").distinct(), "marked")
    unstage(coarse)
    linked = nodes.join(small_or_plain(marked, 16), "node", "left_semi").select("node", "x", "copies")
    entries = stage(arrow_map(linked, _exact(args), "key long, node long, v binary"), "filters")
    found = stage(arrow_map(tiled(entries, entries, tile, ["v"]), _link(cosine), "kind int, u long, v long"), "vector_links")
    unstage(entries)
    count = found.where("kind = 0").groupBy("u").agg(F.sum("v").alias("n"))
    part = connected_components(found.where("kind = 1").select("u", "v").distinct())
    named = (ids.join(count, F.col("node") == F.col("u"), "left").drop("u")
             .join(part.withColumnRenamed("node", "u"), F.col("node") == F.col("u"), "left")
             .select("f1", "f2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
                     F.coalesce("component", "node").alias("c"), F.lit(True).alias("sound")))
    out = rows.drop("embedding").join(named, ["f1", "f2", "sound"], "left")
    cid = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"),
                      F.coalesce(cid == F.col("vec_id"), F.lit(True)).alias("kept"))
