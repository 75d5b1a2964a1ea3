"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

The units are the bytes of the text, each a symbol of its own: no two letters, digits or signs are taken
for one another. The model is of order five, or of any order whose codes fit a long. The n-grams of all
trusted documents are counted in tables that grow with the corpus; counts, context totals, continuation
counts and discounts of every length are joined by context into the probability of every n-gram that
occurs in a document. ``train`` also takes an alphabet that folds bytes to fewer symbols.

Scoring joins too, and sends no table whole to anyone: documents are packed into units of bounded text and
bounded distinct n-grams, the n-grams of a unit meet their probabilities by code and come back to the unit's
texts. Documents are kept up to a quantile of the perplexity that trusted documents of their language have
which the model was not trained on.

Defined cases: null or empty text has no perplexity and is not kept; a null language is a language of
its own; a language without trusted documents gets the threshold over all trusted documents; without
any trusted document nothing is rejected but empty text; a null doc_id is never trusted; repeated rows
are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm import text as T
from trialspark.llm.staging import arrow_map, small_or_plain, stage, tidy

SYMBOLS = 64
MARKS = ".,!?;:-'\"()|$%&#*/"
LINE = 1


def _symbol(b: int) -> int:
    if 97 <= b <= 122:
        return 2 + b - 97
    if 65 <= b <= 90:
        return 28 + (b - 65) % 8
    if b >= 128:
        return 55 + b % 8
    if 48 <= b <= 57:
        return 36
    if chr(b) in MARKS:
        return 37 + MARKS.index(chr(b))
    return LINE if b in (10, 13) else 0 if b in (9, 32) else 63


_FOLD = np.array([_symbol(b) for b in range(256)], dtype=np.int32)


class Alphabet(NamedTuple):
    """A symbol below ``size`` for every byte."""
    size: int
    fold: np.ndarray


FOLDED = Alphabet(SYMBOLS, _FOLD)
BYTES = Alphabet(256, np.arange(256, dtype=np.int32))


#: n-grams that a worker holds before it passes them on, and rows that leave it at once
HELD = 1 << 20
SLICE = 1 << 16
#: bytes of text in a unit of documents
UNIT_BYTES = 32 << 20
_ZSTD = 9


def _grams(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, order: int) -> np.ndarray:
    """Code of the n-gram that ends at each byte of the texts, line marks in front of every text."""
    size, lead = np.diff(offsets), order - 1
    at = np.arange(len(data)) + lead * np.repeat(np.arange(len(size)), size)
    s = np.full(len(data) + lead * len(size), int(alphabet.fold[10]), dtype=np.int64)
    s[at + lead] = alphabet.fold[data]
    code = s[:len(s) - lead].copy()
    for k in range(1, order):
        code *= alphabet.size
        code += s[k:len(s) - lead + k]
    return code[at]


def _trigrams(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of every text, and the offsets of the texts."""
    return _grams(data, offsets, alphabet, 3), offsets


def _codes(column: pa.Array, alphabet: Alphabet, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks (first row, n-gram codes, offsets) of a string column; a longer text comes in pieces, one after the other."""
    for a, _, data, offsets in T.texts(column):
        if len(data) <= T.CHUNK_BYTES:
            yield a, _grams(data, offsets, alphabet, order), offsets
            continue
        for x in range(0, len(data), T.CHUNK_BYTES):
            before = min(x, order - 1)
            part = data[x - before:x + T.CHUNK_BYTES]
            code = _grams(part, np.array([0, len(part)]), alphabet, order)[before:]
            yield a, code, np.array([0, len(code)])


def _tally(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, unsorted, and how often each occurs."""
    found = pa.array(code).value_counts()
    return found.field(0).to_numpy(), found.field(1).to_numpy()


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and their summed counts."""
    code, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found)) or ((), ())))
    by = np.argsort(code, kind="stable")
    code, n = code[by], n[by]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _sliced(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(next(iter(columns.values()))), SLICE):
        yield pa.RecordBatch.from_pydict({name: pa.array(x[a:a + SLICE]) for name, x in columns.items()})


def _count_batches(alphabet: Alphabet, order: int):
    def run(batches):
        found, held = [], 0
        for batch in batches:
            for _, code, _ in _codes(batch.column(0), alphabet, order):
                found.append(_tally(code))
                held += len(found[-1][0])
                if held > 2 * HELD:
                    found = [_summed(found)]
                    held = len(found[0][0])
                    if held > HELD:
                        yield from _sliced(dict(zip(("code", "n"), found[0])))
                        found, held = [], 0
        yield from _sliced(dict(zip(("code", "n"), _summed(found))))
    return run


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=_ZSTD))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(data) as stream:
        yield from stream


def _unit_batches(alphabet: Alphabet, order: int):
    """A row for each batch of rows: its unit, the rows, and the n-grams that the unit did not have before. A unit ends
    with the batch that fills its text or its n-grams."""
    def run(batches):
        task = TaskContext.get()
        unit = (task.partitionId() if task else 0) << 33
        size, seen = 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            own = np.zeros(0, dtype=np.int64)
            parts, held = [], 0
            for _, code, _ in _codes(batch.column(2), alphabet, order):
                parts.append(pa.array(code).unique().to_numpy())
                held += len(parts[-1])
                if held > 2 * HELD:
                    own, parts, held = np.unique(np.concatenate([own, *parts])), [], 0
            own = np.setdiff1d(np.concatenate([own, *parts]), seen)
            new = pa.RecordBatch.from_pydict({"code": pa.array(own)})
            yield pa.RecordBatch.from_pydict({"unit": pa.array([unit], pa.int64()), "rows": pa.array([_packed(batch)], pa.binary()),
                                              "codes": pa.array([_packed(new)], pa.binary())})
            size, seen = size + batch.column(2).nbytes, np.union1d(seen, own)
            if size >= UNIT_BYTES or len(seen) >= HELD:
                unit, size, seen = unit + 1, 0, seen[:0]
    return run


def _unit_codes(unit: tuple, table: pa.Table) -> pa.Table:
    """(unit, code) of every distinct n-gram of a unit."""
    code = pa.concat_arrays([b.column(0) for x in table["codes"] for b in _unpacked(x.as_buffer())])
    out = pa.table({"unit": pa.repeat(unit[0], len(code)), "code": code})
    tidy()
    return out


def _unit_scores(alphabet: Alphabet, order: int):
    def run(units: pa.Table, weights: pa.Table) -> pa.Table:
        code, logp = (weights[k].to_numpy() for k in ("code", "logp"))
        by = np.argsort(code)
        code, logp = code[by], logp[by]
        done = []
        for x in units["rows"]:
            for batch in _unpacked(x.as_buffer()):
                n, ll = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
                for a, found, offsets in _codes(batch.column(2), alphabet, order):
                    own = pa.array(found).dictionary_encode()
                    key = own.dictionary.to_numpy()
                    at = np.searchsorted(code, key)
                    if not np.array_equal(code[np.minimum(at, len(code) - 1)] if len(code) else code, key):
                        raise RuntimeError("a unit's texts hold n-grams without a probability: its rows changed between two readings")
                    size = np.diff(offsets)
                    n[a:a + len(size)] += size
                    ll[a:a + len(size)] += np.bincount(np.repeat(np.arange(len(size)), size),
                                                       logp[at][own.indices.to_numpy()], len(size))
                per = np.exp(-ll / np.maximum(n, 1))
                done.append(pa.table([batch.column(0), batch.column(1), pa.array(n), pa.array(per, mask=n == 0)],
                                     names=["doc_id", "lang", "n", "perplexity"]))
        out = pa.concat_tables(done).combine_chunks()
        tidy()
        return out
    return run


def _counts(docs: DataFrame, alphabet: Alphabet, order: int) -> DataFrame:
    """(code, c) of the n-grams of ``docs`` (text)."""
    return (arrow_map(docs.select("text"), _count_batches(alphabet, order), "code long, n long")
            .groupBy("code").agg(F.sum("n").alias("c")))


def _discounts(counts: DataFrame) -> dict:
    """Modified Kneser-Ney discount of a count ``c`` for every length, its three values taken from the counts of counts."""
    got = counts.groupBy("length").agg(*[F.sum((F.col("c") == k).cast("long")) for k in range(1, 5)]).collect()
    out = {}
    for length, *n in got:
        d = []
        for k, default in enumerate((0.5, 0.75, 0.9)):
            x = k + 1 - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k + 1] / n[k] if n[0] and n[k] else default
            d.append(x if 0 < x < k + 1 else default)
        c = F.col("c")
        out[length] = F.when(c >= 3, d[2]).when(c >= 2, d[1]).when(c >= 1, d[0]).otherwise(0.0)
    return out


def train(trusted: DataFrame, alphabet: Alphabet = FOLDED, codes: DataFrame | None = None, order: int = 3) -> DataFrame:
    """(code, logp) of the n-grams ``codes`` (distinct code), or of all: natural log of p(last | all before), from
    ``trusted`` (text)."""
    size, spark = alphabet.size, trusted.sparkSession
    # (code, c) of every length: the longest counted in the texts, a shorter one by how many n-grams it ends
    counts = {order: stage(_counts(trusted, alphabet, order), "grams")}
    for length in range(order - 1, 0, -1):
        shorter = counts[length + 1].select((F.col("code") % size ** length).alias("code"))
        counts[length] = shorter.groupBy("code").agg(F.count("*").alias("c"))
    every = reduce(DataFrame.unionByName, [c.select(F.lit(length).alias("length"), "code", "c") for length, c in counts.items()])
    every = stage(every, "lengths")
    discounts = _discounts(every)

    if codes is None:
        codes = spark.range(size ** order).select(F.col("id").alias("code"))
    codes = codes.select(F.col("code").cast("long").alias("code"))
    context = F.expr(f"code div {size}").alias("context")

    # probabilities of one length are interpolated with those of the next shorter; n-grams, contexts and counts meet by
    # code and context. The length zero has one n-gram, the empty one
    p = spark.range(1).select(F.col("id").alias("lower"), F.lit(1.0 / size).alias("q"))
    for length in range(1, order + 1):
        rows = codes if length == order else codes.select((F.col("code") % size ** length).alias("code")).distinct()
        seen, discount = every.where(F.col("length") == length), discounts.get(length, F.lit(0.0))
        freed = seen.groupBy(context).agg(F.sum("c").alias("total"), F.sum(discount).alias("freed"))
        own = seen.select("code", (F.col("c") - discount).alias("left"))
        got = (rows.select("code", context, (F.col("code") % size ** (length - 1)).alias("lower")).join(p, "lower")
               .join(freed, "context", "left").join(own, "code", "left"))
        q = (F.coalesce("left", F.lit(0.0)) + F.col("freed") * F.col("q")) / F.col("total")
        p = got.select(F.col("code").alias("lower"), F.coalesce(q, F.col("q")).alias("q"))
    return stage(p.select(F.col("lower").alias("code"), F.log("q").alias("logp")), "kneser_ney")


def perplexities(docs: DataFrame, model: DataFrame, alphabet: Alphabet = FOLDED, order: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n (symbols), perplexity (null without text). ``model`` (code, logp)
    holds every n-gram of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    # both readers of the units take all their columns, so that they share one exchange
    units = arrow_map(rows, _unit_batches(alphabet, order), "unit long, rows binary, codes binary")
    wanted = units.groupBy("unit").applyInArrow(_unit_codes, "unit long, code long")
    weights = wanted.join(model, "code").select("unit", "code", "logp")
    return units.groupBy("unit").cogroup(weights.groupBy("unit")).applyInArrow(
        _unit_scores(alphabet, order), "doc_id long, lang string, n long, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, accuracy: int = 10_000,
             order: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, lang, text): doc_id, lang, n, perplexity, threshold, kept.
    ``labels`` (doc_id, quality) mark trusted documents with quality 1; half of them, by crc32 of
    doc_id, train the model and the others set the thresholds."""
    docs = docs.select("doc_id", "lang", "text")
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn(
        "trains", F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    trusted = stage(trusted, "trusted")
    codes = stage(_counts(docs, BYTES, order).select("code"), "codes")
    model = train(docs.join(small_or_plain(trusted.where("trains"), 16), "doc_id", "left_semi"), BYTES, codes, order)
    scored = stage(perplexities(docs, model, BYTES, order), "perplexities")
    held = stage(scored.join(trusted.where("not trains"), "doc_id", "left_semi").where("perplexity is not null"), "held")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(accuracy))
    by_lang = held.groupBy(F.coalesce("lang", F.lit("")).alias("__lang")).agg(cut.alias("own"))
    overall = held.agg(cut).first()[0]
    limit = F.coalesce("own", F.lit(float("inf") if overall is None else overall))
    return (scored.withColumn("__lang", F.coalesce("lang", F.lit(""))).join(by_lang, "__lang", "left")
            .select("doc_id", "lang", "n", "perplexity", limit.alias("threshold"),
                    F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept")))
