"""Comparing all rows of a key inside tasks: large keys are cut into pairs of tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.staging import small_or_plain, stage


def tiled(entries: DataFrame, keys: DataFrame, tile: int, carry: list[str]) -> DataFrame:
    """Entries (key, node, ...) as (key, i, j, node, side, ...), dealt by (key, i, j) and sorted: a key
    with up to ``tile`` rows (by ``keys``, a staged table with the same keys) is the one tile (0, 0), a larger one is cut by hash into tiles, and every
    two tiles (and each with itself) meet under a key of their own, so that no task gets a whole hot key."""
    large = stage(keys.groupBy("key").count().where(F.col("count") > tile)
                  .select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "large_keys")
    own = F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int")
    e = entries.join(small_or_plain(large, 16), "key", "left").withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda o: F.struct(
        F.least("own", o).cast("long").alias("i"), F.greatest("own", o).cast("long").alias("j"),
        (F.col("own") < o).alias("side")))
    return (e.select("key", "node", *carry, F.explode(pairs).alias("p"))
            .select("key", "p.i", "p.j", "node", "p.side", *carry)
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"))


def groups(batches):
    """((key, i, j), table of its rows) for every key with at least two rows in a sorted partition."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        key = np.stack([held.column(k).to_numpy() for k in range(3)], axis=1)
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        edges = [0, *cut.tolist()]
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                yield tuple(key[a].tolist()), held.slice(a, b - a)
        held = held.slice(edges[-1])
    if held is not None and held.num_rows > 1:
        yield tuple(held.column(k)[0].as_py() for k in range(3)), held


def answerable(mask: np.ndarray, rows: pa.Table, i: int, j: int) -> np.ndarray:
    """``mask`` without the pairs that other tiles answer for, and without a row and itself."""
    if i != j:
        side = rows.column("side").to_numpy(zero_copy_only=False)
        mask &= side[:, None] != side[None, :]
    np.fill_diagonal(mask, False)
    return mask


def runs(batches, keys):
    """Tables of the rows of each key in a sorted partition."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None or not held.num_rows else pa.concat_tables([held, t]).combine_chunks()
        n = held.num_rows
        if not n:
            continue
        cut = np.zeros(n - 1, dtype=bool)
        for k in keys:
            c = held.column(k)
            cut |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy()
        edges = [0, *(np.flatnonzero(cut) + 1).tolist()]
        for a, b in zip(edges[:-1], edges[1:]):
            yield held.slice(a, b - a)
        held = held.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held
