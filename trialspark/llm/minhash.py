"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct shingles. The sketch follows the fast
similarity sketching scheme: in round i every element is hashed to one bin and a value that
begins with i, each bin keeps its least value, and from round t on bin i - t takes all elements,
so that every one of the t coordinates is filled after at most 2 t rounds. Documents with equal
sets are one node; nodes that share a band are candidates; candidates are linked only if their
full sets reach the threshold.

Candidates of a band are not paired with each other at once. Every member is first verified
against the smallest member, components are formed, and only bands whose members still lie in
different components are compared further: their sets meet in tasks, large bands cut into pairs of
tiles, a pair of documents is compared in the first band it shares, and only a spanning forest of the
links found leaves the task. A group of thousands of near copies so costs one comparison for most of
them, no pairs are written out, and no link is lost.

Defined cases: null text or a text without words has the empty set, n_shingles 0, and links with
nothing; fewer words than a shingle make one shingle; rows with one doc_id count as one document;
a null doc_id takes part through its text, is never a class id, and is its own class (null) when
nothing else has its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm import text as T
from trialspark.llm.components import connected_components, forest
from trialspark.llm.staging import arrow_map, small_or_plain, stage
from trialspark.llm.tiles import answerable, groups, tiled

#: (bands, coordinates per band): a pair at similarity 0.8 shares no band with probability 6e-5.
BANDS, ROWS = 32, 6
#: members of a band that are compared in one task at once
TILE = 400


def shingle_sets(data, offsets, k: int):
    """Distinct shingle hashes of every text of a chunk, sorted, and the offsets of the texts."""
    h, first = T.words(data, offsets, T.NONSPACE)
    out, ends = [], [0]
    with np.errstate(over="ignore"):
        rolled = h.copy() if k == 1 else h[:max(len(h) - k + 1, 0)].copy()
        for j in range(1, k):
            rolled = T.mix(rolled * T.U(0x9E3779B97F4A7C15) + h[j:len(h) - k + 1 + j])
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                s = np.unique(rolled[a:b - k + 1])
            elif b > a:
                x = np.full(1, b - a, dtype=T.U)
                for w in h[a:b]:
                    x = T.mix(x * T.U(0x9E3779B97F4A7C15) + w)
                s = x
            else:
                s = h[:0]
            out.append(s)
            ends.append(ends[-1] + len(s))
    return (np.concatenate(out) if out else h[:0]), np.array(ends, dtype=np.int64)


def sketches(flat: np.ndarray, ends: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches (texts x t) of non-empty sets; rows of empty sets stay at the top value."""
    n = len(ends) - 1
    top = np.iinfo(np.uint64).max
    S = np.full(n * t, top, dtype=T.U)
    seed = T.seeds(2 * t, 5000)
    sizes = np.diff(ends)
    x, d = flat, T.ranges(ends)
    open_ = sizes > 0
    low = T.U(0xFFFFFFFF)
    for i in range(2 * t):
        if not len(x):
            break
        with np.errstate(over="ignore"):
            v = T.mix(x ^ seed[i])
            value = (T.U(i) << T.U(32)) | (v & low)
            place = d * t + (((v >> T.U(32)) * T.U(t)) >> T.U(32)).astype(np.int64) if i < t else d * t + (i - t)
        np.minimum.at(S, place, value)
        still = open_ & (S.reshape(n, t) == top).any(axis=1)
        if still.sum() < open_.sum():
            open_ = still
            keep = open_[d]
            x, d = x[keep], d[keep]
    return S.reshape(n, t)


def fingerprints(flat: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, T.U), np.cumsum(T.mix(flat ^ T.U(seed)), dtype=T.U)])
        return T.mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(T.U))


def _sketch_batches(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in T.texts(batch.column(1)):
                flat, ends = shingle_sets(data, offsets, k)
                key = _band_keys(flat, ends, bands, rows)
                n = np.diff(ends)
                full = n > 0
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), T.longs(n), T.longs(fingerprints(flat, ends, 11)),
                     T.longs(fingerprints(flat, ends, 22)),
                     T.lists(key[full].ravel(), np.concatenate([[0], np.cumsum(full * bands)]))],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"])
    return run


def _band_keys(flat: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    S = sketches(flat, ends, bands * rows).reshape(len(ends) - 1, bands, rows)
    with np.errstate(over="ignore"):
        key = np.zeros((len(ends) - 1, bands), dtype=T.U)
        for j in range(rows):
            key = T.mix(key * T.U(0x9E3779B97F4A7C15) + S[:, :, j])
    return key.view(np.int64)


def _set_batches(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in T.texts(batch.column(1)):
                flat, ends = shingle_sets(data, offsets, k)
                keys = _band_keys(flat, ends, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), T.lists(flat, ends),
                     T.lists(keys.ravel(), np.arange(b - a + 1) * bands)], names=["node", "s", "bands"])
    return run


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[i]."""
    own, at = np.unique(np.concatenate(sets), return_inverse=True)
    width = -(-len(own) // 8)
    if width * len(sets) > 64 << 20:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)])
    bits = np.zeros((len(sets), width), dtype=np.uint8)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at >> 3),
                     np.left_shift(1, at & 7).astype(np.uint8))
    step = max(1, (16 << 20) // max(width, 1))
    return np.concatenate([np.bitwise_count(bits[a[i:i + step]] & bits[b[i:i + step]]).sum(axis=1, dtype=np.int64)
                           for i in range(0, len(a), step)])


def _compare(percent: int):
    def run(batches):
        for (_, i, j), rows in groups(batches):
            node, part = rows.column("node").to_numpy(), rows.column("part").to_numpy()
            band = rows.column("pos").to_numpy()[0]
            sets = [np.array(x, dtype=np.int64) for x in rows.column("s").to_pylist()]
            size = np.array([len(s) for s in sets])
            keys = np.array(rows.column("bands").to_pylist(), dtype=np.int64)
            ask = (part[:, None] != part[None, :]) & (np.minimum(size[:, None], size) * 100
                                                      >= np.maximum(size[:, None], size) * percent)
            for earlier in range(band):  # a pair that shares an earlier band is compared there
                ask &= keys[:, None, earlier] != keys[None, :, earlier]
            a, b = np.nonzero(np.triu(answerable(ask, rows, i, j)))
            if len(a):
                both = _intersections(sets, a, b)
                near = both * 100 >= (size[a] + size[b] - both) * percent
                u, v = forest(node[a[near]], node[b[near]])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets reach the similarity."""
    inter = F.size(F.array_intersect("su", "sv"))
    su, sv = F.size("su"), F.size("sv")
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    return (two.where(F.least(su, sv) * 100 >= F.greatest(su, sv) * percent)
            .where(inter * 100 >= (su + sv - inter) * percent).select("u", "v"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """Classes of documents whose sets of k-word shingles have a Jaccard similarity of at least
    percent / 100. Returns one row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = stage(arrow_map(docs, _sketch_batches(k, bands, rows),
                         "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sketches")
    nodes = stage(sk.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"),
                                                                    F.min("n_shingles").alias("n")), "nodes")
    first = sk.where("n_shingles > 0").join(
        nodes.select(F.col("node").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi")
    band = first.select(F.col("doc_id").alias("node"), F.posexplode("bands")).select(
        F.xxhash64("pos", "col").alias("band"), "node", "pos")
    shared = band.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = stage(band.join(shared, "band").select("band", "node", "pos", "low"), "members")

    star = stage(members.where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct(),
                 "pairs")
    wanted = stage(star.select(F.col("u").alias("doc_id")).union(star.select("v")).distinct(), "wanted")
    sets = stage(arrow_map(docs.join(small_or_plain(wanted, 16), "doc_id", "left_semi"), _set_batches(k, bands, rows),
                           "node long, s array<long>, bands array<long>"), "sets")
    links = stage(_verified(star, sets, percent), "links")
    part = connected_components(links)

    # bands whose members are still apart: compare members of different components
    placed = stage(members.join(part, "node", "left").select(
        "band", "node", "pos", F.coalesce("component", "node").alias("part")), "placed")
    mixed = placed.groupBy("band").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
    apart = stage(placed.join(mixed.select("band"), "band").select(F.col("band").alias("key"), "node", "pos", "part"),
                  "apart")
    more = arrow_map(tiled(apart.join(sets, "node"), apart, TILE, ["pos", "part", "s", "bands"]), _compare(percent),
                     "u long, v long")
    part = connected_components(links.union(more))

    named = nodes.join(part, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("c"))
    out = sk.drop("bands").join(named, ["f1", "f2"], "left")
    cid = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"),
                      F.coalesce(cid == F.col("doc_id"), F.col("doc_id").isNull() & F.col("c").isNull()).alias("kept"))
