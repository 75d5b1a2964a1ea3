"""Connected components: contraction inside tasks, and alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.staging import arrow_map, stage, unstage

#: edges that one task contracts at a time (16 bytes each)
PER_TASK = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes that are not the least, by hooking and
    pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(most: int):
    def run(batches):
        u = v = np.zeros(0, np.int64)
        for batch in batches:
            u = np.concatenate([u, batch.column(0).to_numpy()])
            v = np.concatenate([v, batch.column(1).to_numpy()])
            if len(u) > most:
                u, v = forest(u, v)
                if len(u) > most // 2:  # little left to gain: pass the stars on
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    u = v = u[:0]
        u, v = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    return run


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """(edges, nodes that keep ``edges`` from being stars: with two parents, or a parent and a child)."""
    ends = (edges.groupBy("u").agg(F.count("*").alias("up"), F.lit(0).alias("down")).withColumnRenamed("u", "x")
            .union(edges.groupBy("v").agg(F.lit(0).alias("up"), F.count("*").alias("down"))))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    r = per.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return int(r[0] or 0), int(r[1])


def _star_round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def connected_components(links: DataFrame, native: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """Components of an undirected graph given as columns (u, v) of long ids, repeats allowed.

    Returns staged (node, component) for every node that is not itself the smallest of its component;
    component is the smallest id reachable. A round is a large-star and a small-star step, each a
    partially aggregated minimum and an equi-join, so that a node with very many links is split over
    tasks; rounds end when the edges are stars. Unless ``native``, tasks first replace the edges they
    hold by stars in every round, and edges that are counted to fit one task (``per_task``) are done
    then. Only two counts reach the driver.
    """
    edges = stage(links.where("u <> v").select("u", "v"), "edges")
    n = None if native else edges.count()
    while True:
        if not native:
            tasks = max(1, -(-n // max(per_task, 1)))
            local = stage(arrow_map(edges.coalesce(tasks), _contract(max(per_task, 1)), "u long, v long"), "edges")
            unstage(edges)
            edges = local
            if n <= per_task:
                break
        new = stage(_star_round(edges), "edges")
        unstage(edges)
        edges = new
        n, bad = _unsettled(edges)
        if not bad:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
