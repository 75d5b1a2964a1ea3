"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's size is its number of words. Sources take part of the mix by weight; no source gives
more than twice its words, and what a source cannot give is shared by the others, by weight.

Every source's documents are put in a random but repeatable order (an md5 of seed and doc_id) and
laid end to end twice; the mix takes the words of that line up to the source's target. A document
laid on the line is a block. The blocks a source gives are dealt to the output shards by a
splitting tree: at each node the blocks of all sources together are halved, and how many of each
source go left is a multivariate-hypergeometric draw, so shards are equally large, quotas are
exact, and the mix of every shard is random as if all blocks had been shuffled. Each shard then
takes its own range of every source's permuted blocks, disjoint from all others, and shuffles it.

The order within a source needs no global sort: documents are ranked inside hash buckets of their
source, and bucket totals are added up in front. The tree runs on one row for each source.

Defined cases: null text has size 0 and takes nothing; a null source is a source, the last in order;
a null doc_id orders first in its bucket; repeated rows are separate blocks; an empty table gives an
empty mix; a source without words has target 0.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.staging import stage

WEIGHTS = (3.0, 1.0, 2.0)
PASSES = 2


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than space and \\t to \\r."""
    # one character for every word: runs of other characters become one mark, then blanks go
    marks = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = PASSES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources by
    code point with null last; targets add up to ``share`` of all words, none over ``most`` times its source."""
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # sources that fill up first come first; beyond the last that does, words go by weight
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    past, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(past), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(past), F.lit(0.0))))
    w = w.withColumn("level", level)
    open_ = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    final = F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by_weight = F.col("final") * F.col("weight")
    return w.withColumn("final", final).select(
        "source", "source_size", F.coalesce(F.least("cap", F.when(F.col("final").isNotNull(), by_weight)), "cap").alias("target"))


def _log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good: inversion outwards from the mode, so the
    steps go with the standard deviation and not with the counts."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_p(x: int) -> float:
        return (_log_factorial(good) - _log_factorial(x) - _log_factorial(good - x) + _log_factorial(bad)
                - _log_factorial(draws - x) - _log_factorial(bad - draws + x) - _log_factorial(good + bad)
                + _log_factorial(draws) + _log_factorial(good + bad - draws))

    u = rng.random()
    p = math.exp(log_p(mode))
    u -= p
    a = b = mode
    pa = pb = p
    while u > 0 and (a > low or b < high):
        if b < high:
            pb *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= pb
            if u <= 0:
                return b
        if a > low:
            pa *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= pa
            if u <= 0:
                return a
    return mode


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of every source for each shard: shards x sources, columns adding up to ``quotas``."""
    rng = random.Random(seed)

    def split(q: list[int], n: int) -> list[list[int]]:
        if n == 1:
            return [q]
        left_n = n // 2
        draws = sum(q) * left_n // n
        left, rest = [], sum(q)
        for x in q:
            take = hypergeometric(rng, x, rest - x, draws)
            left.append(take)
            rest -= x
            draws -= take
        return split(left, left_n) + split([x - y for x, y in zip(q, left)], n - left_n)

    return split(list(quotas), shards)


def _lines(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    """``docs`` with __size, the place among its source's non-empty documents (__rank) and the words
    before it (__ahead) inside its bucket of the source's random order."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.withColumn("__size", word_count()).withColumn("__h", h)
    d = d.withColumn("__bucket", F.floor(F.conv(F.substring("__h", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)))
    # a key that is never null, so that windows and joins on it share one partitioning
    d = d.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    mine = Window.partitionBy("__source", "__bucket").orderBy("__h", "doc_id", "__size")
    before = mine.rowsBetween(Window.unboundedPreceding, -1)
    return (d.withColumn("__rank", F.coalesce(F.sum((F.col("__size") > 0).cast("long")).over(before), F.lit(0)))
            .withColumn("__ahead", F.coalesce(F.sum("__size").over(before), F.lit(0))))


def _placed(d: DataFrame, fronts: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines with, for every pass, the block number and the words the mix takes of it."""
    p = d.join(fronts, ["__source", "__bucket"]).join(targets, "__source")
    at, place = F.col("__words_before") + F.col("__ahead"), F.col("__n_before") + F.col("__rank")
    return p.withColumn("__blocks", F.array(*[F.struct(
        F.lit(k).alias("pass"), (F.lit(k) * F.col("__source_n") + place).alias("block"),
        F.greatest(F.least(F.round("target").cast("long") - F.lit(k) * F.col("source_size") - at, F.col("__size")),
                   F.lit(0)).cast("long").alias("take")) for k in range(PASSES)]))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, shards: int = 64, seed: int = 17,
        buckets: int = 4096, carry: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, source and any other columns; doc_id and source alone without ``carry``) with size, source_size, target, taken
    (words the mix takes of the row, both passes) and draws, an array of (pass, block, take, shard)
    for the blocks that the shards draw. Columns of these names are replaced."""
    made = ("size", "source_size", "target", "taken", "draws")
    docs = docs.drop(*made)
    narrow = stage(_lines(docs.select("doc_id", "text", "source"), seed, buckets).drop("text"), "lines")
    bucket = narrow.groupBy("__source", "__bucket").agg(
        F.sum("__size").alias("words"), F.sum((F.col("__size") > 0).cast("long")).alias("n"))
    in_front = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    fronts = stage(bucket.select(
        "__source", "__bucket", F.coalesce(F.sum("words").over(in_front), F.lit(0)).alias("__words_before"),
        F.coalesce(F.sum("n").over(in_front), F.lit(0)).alias("__n_before")), "fronts")
    sizes = narrow.groupBy("source").agg(F.sum("__size").alias("source_size"),
                                         F.sum((F.col("__size") > 0).cast("long")).alias("__source_n"))
    t = source_targets(sizes.select("source", "source_size"), weights, share)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    targets = stage(t.select(key.alias("__source"), "source_size", "target").join(
        sizes.select(key.alias("__source"), "__source_n"), "__source"), "targets")

    # the tree runs on one number for each source: how many blocks it gives
    quota = (_placed(narrow, fronts, targets).select("__source", F.explode("__blocks").alias("b"))
             .groupBy("__source").agg(F.sum((F.col("b.take") > 0).cast("long")).alias("q")).orderBy("__source").collect())
    dealt = splitting_tree([r.q for r in quota], shards, seed)
    rows = []
    for i, r in enumerate(quota):
        ends, total = [], 0
        for shard in dealt:
            total += shard[i]
            ends.append(total)
        rows.append((r["__source"], ends))
    ends = docs.sparkSession.createDataFrame(rows, "__source string, __ends array<long>")

    # with nothing more to carry the staged lines serve again; other columns travel with the second pass
    lines = narrow if not carry else _lines(docs, seed, buckets)
    columns = docs.columns if carry else ["doc_id", "source"]
    p = _placed(lines, fronts, targets.join(ends, "__source"))
    # a shard draws the blocks between its end and the end of the shard before
    drawn = F.filter(F.transform("__blocks", lambda b: F.struct(
        b["pass"].alias("pass"), b["block"].alias("block"), b["take"].alias("take"),
        F.size(F.filter("__ends", lambda e: e <= b["block"])).alias("shard"))),
        lambda b: (b["shard"] < shards) & (b["take"] > 0))
    p = p.withColumn("draws", drawn)
    return p.select(*columns, F.col("__size").alias("size"), "source_size", "target",
                    F.aggregate("draws", F.lit(0).cast("long"), lambda s, b: s + b["take"]).alias("taken"), "draws")


def blocks(mixed: DataFrame, columns: list[str], seed: int = 17, parts: int = 8) -> DataFrame:
    """The mix itself: one row for each drawn block with ``columns`` (the text cut behind the words taken,
    where a block is taken in part), taken, shard and shuffle key. The rows of a shard meet in ``parts``
    parts, dealt by their shuffle keys, each whole in one task and in the shuffled order."""
    out = mixed.select("*", F.explode("draws").alias("__b"))
    # a piece is a word and what parts it from the next; what is in front of the first word is one more
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    take = F.col("__b.take").cast("int") + F.col("text").rlike(r"\A[\x20\x09-\x0D]").cast("int")
    head = F.regexp_replace(F.array_join(F.slice(pieces, 1, take), ""), r"[\x20\x09-\x0D]+\z", "")
    text = F.when(F.col("__b.take") < F.col("size"), head).otherwise(F.col("text"))
    named = [text.alias("text") if c == "text" else F.col(c) for c in columns]
    # own names on the way, as ``columns`` may hold the final ones
    out = out.select(*named, F.col("__b.take").alias("__taken"), F.col("__b.shard").alias("__shard"),
                     F.xxhash64(F.lit(seed), "__b.pass", "doc_id", "__b.block").alias("__shuffle"))
    return (out.repartition("__shard", F.pmod("__shuffle", F.lit(parts))).sortWithinPartitions("__shard", "__shuffle")
            .select(*columns, F.col("__taken").alias("taken"), F.col("__shard").alias("shard"),
                    F.col("__shuffle").alias("shuffle")))
