"""License scan by diagonal voting.

All rolling word k-gram hashes of every document are joined to the k-gram positions of the license
templates. A match votes for the diagonal (document position minus template position); votes of a
document and template are summed by diagonal, neighbouring diagonals are merged into one span (a few
words were inserted or left out), and every span is verified against the template's words: phrases
must stand there word by word, longer texts must agree in order with a share of their words. Templates
that name one variant of a license (its version, NC, Lesser, Affero) also need the words that tell it from
the other variants, whole and side by side in the span; as those words differ, two variants cannot claim
the same place, and a text that names both gets both labels.

Templates are fixed and few, so their side of the join is small by construction.

Defined cases: null text is empty: no words, no labels, score 0; a null doc_id is matched by its text;
rows with one doc_id are each verified on their own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm import text as T
from trialspark.llm.staging import arrow_map, small_or_plain, stage

# The phrases of the contract and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: label and text of longer templates: common statements and openings of public licenses
TEMPLATES = (
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                  "and associated documentation files"),
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("all-rights-reserved", "All rights reserved."),
)
K = 2

#: label: spellings of the words that make the variant, one of which must stand in the span word by word
VARIANTS = {
    "mit-notice": ("mit license",),
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v 2 0"),
    "gpl-3.0": ("general public license version 3", "general public license 3", "general public license v 3"),
    "gpl-2.0": ("general public license version 2", "general public license 2", "general public license v 2"),
    "lgpl": ("lesser general public license",),
    "agpl": ("affero general public license",),
    "mpl-2.0": ("mozilla public license v 2 0", "mozilla public license version 2 0", "mozilla public license 2 0"),
    "cc-by-nc-4.0": ("by nc 4 0",),
    "cc-by-4.0": ("by 4 0",),
}
#: words that make another license of the words of a variant when they stand in front of them
OTHER = {"gpl-3.0": ("lesser", "library", "affero"), "gpl-2.0": ("lesser", "library", "affero")}


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return T.words(data, np.array([0, len(data)]), T.ALNUM)[0]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        g = h[:max(len(h) - k + 1, 0)].copy()
        for j in range(1, k):
            g = T.mix(g * T.U(0x9E3779B97F4A7C15) + h[j:len(h) - k + 1 + j])
    return g


def catalogue() -> list[tuple[str, bool, np.ndarray]]:
    """(label, whether it is a phrase, word hashes) of all templates."""
    return ([(label, True, _words(t)) for label, t in PHRASES] + [(label, False, _words(t)) for label, t in TEMPLATES])


def _gram_batches(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in T.texts(batch.column(1)):
                h, first = T.words(data, offsets, T.ALNUM)
                g = _grams(h, k)
                row, pos = T.ranges(first), T.positions(first)
                inside = np.zeros(len(g), dtype=bool)
                if len(g):
                    inside = row[:len(g)] == row[k - 1:]
                yield pa.RecordBatch.from_arrays(
                    [T.longs(ids[a:b][row[:len(g)][inside]]), pa.array(pos[:len(g)][inside].astype(np.int32)),
                     T.longs(g[inside])], names=["key", "pos", "gram"])
    return run


def _in_order(a: np.ndarray, b: np.ndarray) -> float:
    """Share of b's words that a has in the same order (longest common subsequence)."""
    best = np.zeros(len(b) + 1, dtype=np.int64)
    for w in a:
        take = np.concatenate([[0], best[:-1] + (b == w)])
        best = np.maximum.accumulate(np.maximum(best, take))
    return best[-1] / len(b)


def _stands(a: np.ndarray, marks: list[np.ndarray], other: np.ndarray) -> bool:
    """Whether one of ``marks`` stands in a word by word, with none of the words ``other`` in front."""
    for m in marks:
        for p in range(len(a) - len(m) + 1):
            if (a[p:p + len(m)] == m).all() and not (p and (other == a[p - 1]).any()):
                return True
    return False


def _verify_batches(share: float):
    def run(batches):
        templates = catalogue()
        marks = {label: [_words(m) for m in some] for label, some in VARIANTS.items()}
        other = {label: _words(" ".join(OTHER.get(label, ()))) for label in VARIANTS}
        for batch in batches:
            spans = batch.column(2)
            for a, b, data, offsets in T.texts(batch.column(1)):
                h, first = T.words(data, offsets, T.ALNUM)
                out = []
                for i in range(a, b):
                    own = h[first[i - a]:first[i - a + 1]]
                    places, base, labels, score = set(), set(), set(), 0.0
                    for s in spans[i].as_py() or []:
                        label, phrase, t = templates[s["tid"]]
                        if phrase:
                            for p in range(max(s["start"], 0), min(s["stop"], len(own)) - len(t) + 1):
                                if (own[p:p + len(t)] == t).all():
                                    places.add((p, label))
                                    base.add(label)
                                    score = 1.0
                        else:
                            span = own[max(s["start"], 0):s["stop"]]
                            got = _in_order(span, t)
                            if got >= share and (label not in marks or _stands(span, marks[label], other[label])):
                                labels.add(label)
                                score = max(score, got)
                    starts = [p for p, _ in places]
                    out.append({"n_words": len(own), "n_base": len(places), "first_word": min(starts, default=None),
                                "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
                                "labels": ",".join(sorted(base | labels)), "score": float(score)})
                part = pa.Table.from_pylist(out, schema=OUT)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[c.combine_chunks() for c in part.columns]],
                    names=["doc_id", *OUT.names])
    return run


OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                 ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, share: float = 0.85, drift: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"))
    templates = catalogue()
    grams = spark.createDataFrame(
        [(int(g), i, j, len(t)) for i, (_, _, t) in enumerate(templates)
         for j, g in enumerate(_grams(t, K).view(np.int64))], "gram long, tid int, tpos int, size int")
    votes = (arrow_map(keyed.select("key", "text"), _gram_batches(K), "key long, pos int, gram long")
             .join(F.broadcast(grams), "gram")
             .groupBy("key", "tid", "size", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("votes")))
    line = Window.partitionBy("key", "tid").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > drift).cast("int"), F.lit(1))
    spans = (votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(line))
             .groupBy("key", "tid", "size", "span")
             .agg(F.min("a").alias("start"), (F.max("b") + K).alias("stop"), F.sum("votes").alias("votes"))
             # a template's share can only be reached with this many k-grams in agreement
             .where(F.col("votes") * K >= F.col("size") * share - K)
             .groupBy("key").agg(F.collect_list(F.struct("tid", "start", "stop")).alias("spans")))
    spans = stage(spans, "license_spans")
    return arrow_map(keyed.join(small_or_plain(spans, 96), "key", "left").select("doc_id", "text", "spans"),
                     _verify_batches(share),
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                     "labels string, score double")
