"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, doc, pos), one row for every word of every text, written
in runs sorted by term. A benchmark item is found by its rarest terms: every window of an item
contributes its ``slop`` + 2 rarest terms as anchors, the anchors' postings are shifted by their place
in the item and counted by (doc, item, offset); where at most ``slop`` of a window's anchors are
missing, an offset is a candidate, and only for candidates are the postings of all the item's terms
intersected, offset by offset. Runs of consecutive matches as long as a window are exact phrases;
windows with at most ``slop`` words missing on one offset are proximity matches.

Terms are 64-bit hashes of lower-cased words; a phrase match needs all its words to agree.

Defined cases: null text has no words; an item without words has no window; an item with fewer
words than a window is one window; rows with one doc_id are one document whose postings are
merged; a null doc_id is a document of its own, known by its text; a null item_id counts for
n_hit but not among the items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm import text as T
from trialspark.llm.staging import arrow_map, small_or_plain, stage


#: postings that are sorted into one run, and those of a run that leave the worker at once
RUN_WORDS = 1 << 19
SLICE_WORDS = 1 << 16


def _names(ids: pa.Array, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document keys: the id, or for a null id a hash of the text's words; and whether it is an id."""
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    key = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not named.all():
        with np.errstate(over="ignore"):
            order = T.mix(h ^ T.seeds(len(h), 77))
            total = np.concatenate([np.zeros(1, T.U), np.cumsum(order, dtype=T.U)])
            own = T.mix(total[first[1:]] - total[first[:-1]]) | (T.U(1) << T.U(63))
        key = np.where(named, key, own.view(np.int64))
    return key, named


def _joined(lane: list[np.ndarray]) -> np.ndarray:
    """The arrays of ``lane`` as one; the lane is emptied."""
    out = np.concatenate(lane)
    lane.clear()
    return out


def _run(held: tuple[list, list, list]):
    """The postings of some texts in term order, in batches of ``SLICE_WORDS``; ``held`` is emptied."""
    terms, docs, places = map(_joined, held)
    terms = terms.view(np.int64)
    order = np.argsort(terms, kind="stable")
    for a in range(0, len(order), SLICE_WORDS):
        at = order[a:a + SLICE_WORDS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms[at]), pa.array(docs[at]), pa.array(places[at]), pa.nulls(len(at), pa.bool_())],
            names=["term", "doc", "pos", "named"])


def _postings(batches):
    """A row for every document with its length, and its postings in runs of about ``RUN_WORDS``; texts are
    hashed in small chunks, and what is kept of them are 20 bytes a word."""
    held: tuple[list, list, list] = ([], [], [])
    n_held = 0
    for batch in batches:
        ids = batch.column(0)
        for a, b, data, offsets in T.texts(batch.column(1)):
            h, first = T.words(data, offsets, T.ALNUM)
            key, named = _names(ids.slice(a, b - a), h, first)
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(b - a, pa.int64()), T.longs(key), pa.array(n.astype(np.int32)), pa.array(named)],
                names=["term", "doc", "pos", "named"])
            for lane, values in zip(held, (h, np.repeat(key, n), T.positions(first).astype(np.int32))):
                lane.append(values)
            n_held += len(h)
            if n_held >= RUN_WORDS:
                yield from _run(held)
                n_held = 0
    if n_held:
        yield from _run(held)


def _item_words(batches):
    for batch in batches:
        iid, ids = batch.column(0), batch.column(1)
        for a, b, data, offsets in T.texts(batch.column(2)):
            h, first = T.words(data, offsets, T.ALNUM)
            row = pa.array(T.ranges(first) + a)
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [iid.take(row), ids.take(row), pa.array(T.positions(first).astype(np.int32)), T.longs(h),
                 pa.array(np.repeat(n, n).astype(np.int32))],
                names=["iid", "item_id", "ipos", "term", "m"])


def build_index(docs: DataFrame) -> DataFrame:
    """The staged postings of all words of ``docs`` (doc_id, text); rows with a null term hold a
    document's length in ``pos`` and whether ``doc`` is its doc_id in ``named``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(arrow_map(docs, _postings, "term long, doc long, pos int, named boolean"), "postings", codec="zstd")


def matches(index: DataFrame, items: DataFrame, window: int = 10, slop: int = 1) -> tuple[DataFrame, DataFrame]:
    """(phrases, near): phrase runs (doc, item_id, start, length) of consecutive item words at least
    a window long, and proximity matches (doc, item_id, start) of windows that miss at most ``slop``
    words in place."""
    items = items.select(F.xxhash64("text").alias("iid"), F.col("item_id").cast("string").alias("item_id"), "text")
    word = stage(arrow_map(items, _item_words, "iid long, item_id string, ipos int, term long, m int"), "items")
    place = word.select("iid", "ipos", "term", "m").distinct()
    terms = stage(place.select("term").distinct(), "terms")
    postings = index.where("term is not null").select("term", "doc", "pos")

    seen = stage(postings.join(small_or_plain(terms, 16), "term", "left_semi").groupBy("term").count(), "counts")
    ahead = Window.partitionBy("iid").orderBy("ipos").rowsBetween(0, window - 1)
    windows = (place.join(seen, "term", "left")
               .withColumn("w", F.array_sort(F.collect_list(
                   F.struct(F.coalesce("count", F.lit(0)).alias("n"), "ipos", "term")).over(ahead)))
               .where((F.col("ipos") + window <= F.col("m")) | (F.col("ipos") == 0)))
    # a window whose terms are missing from the corpus more often than the slop allows cannot occur
    anchors = stage(windows.select("iid", "m", F.explode(F.slice("w", 1, slop + 2)).alias("a"))
                    .where("a.n > 0").select("iid", "a.ipos", "a.term", F.when(
                        F.col("m") >= window, 2).otherwise(F.least(F.lit(slop + 2), "m")).alias("need")).distinct(), "anchors")
    found = stage(postings.join(small_or_plain(anchors, 24), "term")
                  .groupBy("doc", "iid", (F.col("pos") - F.col("ipos")).alias("offset"))
                  .agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need")
                  .select("doc", "iid", "offset"), "candidates")

    in_docs = stage(found.select("doc").distinct(), "candidate_docs")
    near_terms = postings.join(small_or_plain(terms, 16), "term", "left_semi").join(
        small_or_plain(in_docs, 16), "doc", "left_semi")
    wanted = found.join(place, "iid").withColumn("pos", F.col("offset") + F.col("ipos")).where("pos >= 0")
    hit = stage(wanted.join(near_terms, ["doc", "pos", "term"]).select("doc", "iid", "offset", "ipos", "m")
                .distinct(), "hits")

    line = Window.partitionBy("doc", "iid", "offset").orderBy("ipos")
    runs = (hit.withColumn("run", F.col("ipos") - F.row_number().over(line))
            .groupBy("doc", "iid", "offset", "m", "run").agg(F.min("ipos").alias("a"), F.count("*").alias("length"))
            .where(F.col("length") >= F.least(F.lit(window), "m"))
            .select("doc", "iid", (F.col("offset") + F.col("a")).alias("start"), "length"))
    ids = word.select("iid", "item_id").distinct()
    within = line.rangeBetween(0, window - 1)
    near = (hit.withColumn("n", F.count("*").over(within))
            .where(F.col("n") >= F.when(F.col("m") >= window, window - slop).otherwise(F.col("m")))
            .select("doc", "iid", (F.col("offset") + F.col("ipos")).alias("start")).distinct())
    return runs.join(ids, "iid").drop("iid"), near.join(ids, "iid").drop("iid")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 1) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurring window), n_items and
    items (sorted ids as strings), contaminated, n_near_items (items with a proximity match)."""
    index = build_index(docs)
    phrases, near = matches(index, items, window, slop)
    phrases = stage(phrases, "phrases")
    before = Window.partitionBy("doc").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = (phrases.select("doc", "start", "length").distinct()
               .withColumn("past", F.coalesce(F.max(end).over(before), F.lit(0)))
               .groupBy("doc").agg(F.sum(F.greatest(end - F.greatest("start", "past"), F.lit(0))).alias("n_hit")))
    named = phrases.groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    near = near.groupBy("doc").agg(F.count_distinct("item_id").alias("near"))
    per = stage(covered.join(named, "doc", "left").join(near, "doc", "full"), "per_doc")
    out = (index.where("term is null").select("doc", F.col("pos").cast("long").alias("n_words"), "named")
           .join(per, "doc", "left"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.when(F.col("named"), F.col("doc")).alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"), items.alias("items"),
                      (n_hit > 0).alias("contaminated"),
                      F.coalesce("near", F.lit(0)).cast("long").alias("n_near_items"))
