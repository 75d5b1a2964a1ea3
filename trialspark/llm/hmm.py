"""Scoring with a hidden Markov language model.

Words are counted over all training documents. The most frequent words have an emission symbol each;
every other word emits one of ``classes`` symbols, by its hash, and is then drawn within the class
with add-one smoothed counts, so that unseen words have probability too. The end of a text is a token
with a symbol of its own. Baum-Welch: each task runs forward and backward over its share of the
training texts, whole ones, of which blocks of bounded length are held at a time, and emits expected
counts, which Spark adds up; the next parameters come from those sums, until a round gains less than a
tolerance. The first parameters come from rounds over a bounded sample of pieces from all parts of the
texts; the rounds that follow are over everything. A text's likelihood is the scaled forward recursion over its
whole symbol sequence, whatever its length, times the within-class probabilities.

Counts of at most ``frequent`` of the most frequent words travel to the tasks (a bound of 16 bytes times
that parameter); all other words of a document meet their counts in a shuffled join.

Words are known by 64-bit hashes, rows by a 64-bit hash of doc_id and text. Defined cases: null text
is the empty text, one end token; a null doc_id counts as the empty text in the crc32 split; repeated
rows are scored alike; without training documents every count is 0 and the base score is 0.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm import text as T
from trialspark.llm.staging import arrow_map, stage

END = int(T.seeds(1, 424242).view(np.int64)[0])
#: tokens of a piece of text in the sample from which training starts
PIECE = 4096


def held_out(column="doc_id", folds: int = 7, fold: int = 2):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds == fold


def _counts(batches):
    for batch in batches:
        held, size = [], 0
        for a, b, data, offsets in T.texts(batch.column(0)):
            held.append(T.words(data, offsets, T.NONSPACE)[0])
            size += len(held[-1])
            if size > 1_000_000:
                yield _unique(held, 0)
                held, size = [], 0
        yield _unique(held, batch.num_rows)


def _unique(held, ends: int) -> pa.RecordBatch:
    term, n = np.unique(np.concatenate([*held, np.zeros(0, T.U)]).view(np.int64), return_counts=True)
    if ends:
        term, n = np.append(term, END), np.append(n, ends)
    return pa.RecordBatch.from_arrays([T.longs(term), T.longs(n)], names=["term", "n"])


class Vocabulary:
    """What tasks need of the word counts: the frequent words, and totals by class."""

    def __init__(self, counts: DataFrame, symbols: int, classes: int, frequent: int):
        total = counts.agg(F.sum("c"), F.count("*")).first()
        self.N, self.V = int(total[0] or 0), int(total[1])
        # the least count that at most ``frequent`` words reach, from the number of words of each count:
        # a top-k over the words themselves would bring k rows from every partition to the driver
        words = counts.where(F.col("term") != END)
        of = words.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(frequent).toPandas()
        reach = of["c"].to_numpy(np.int64)[of["n"].to_numpy(np.int64).cumsum() <= frequent]
        top = words.where(F.col("c") >= (int(reach.min()) if len(reach) else 1 << 62)).toPandas()
        term, c = top["term"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
        order = np.lexsort((term, -c))
        term, c = term[order], c[order]
        own = np.arange(len(term)) < symbols - classes - 1
        self.classes, self.S = classes, symbols
        by = {int(r[0]): (int(r[1]), int(r[2])) for r in counts.where(F.col("term") != END).groupBy(
            F.pmod("term", F.lit(classes)).alias("k")).agg(F.sum("c"), F.count("*")).collect()}
        n, v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for k, (x, y) in by.items():
            n[k], v[k] = x, y
        np.subtract.at(n, term[own] % classes, c[own])
        np.subtract.at(v, term[own] % classes, 1)
        self.log_class = np.log10(n + v + 1.0)
        last = counts.where(F.col("term") == END).first()
        self.end_count = int(last["c"]) if last else 0
        # symbols: 0 the end, 1.. the classes, then the words of their own
        symbol = np.where(own, np.arange(len(term)) + classes + 1, 1 + term % classes)
        order = np.argsort(term)
        self.term, self.count, self.symbol, self.own = term[order], c[order], symbol[order], own[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into the frequent words for every hash, and whether it is one."""
        if not len(self.term):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.term, h), len(self.term) - 1)
        return at, self.term[at] == h


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(first) - 1, values.dtype), np.diff(first) > 0
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some])
    return out


def _encode(vocabulary):
    def run(batches):
        v = vocabulary.value
        for batch in batches:
            for a, b, data, offsets in T.texts(batch.column(1)):
                h, first = T.words(data, offsets, T.NONSPACE)
                h = h.view(np.int64)
                at, known = v.find(h)
                gain = np.where(known, np.log10(v.count[at] + 1.0) if len(v.count) else 0.0, 0.0)
                own = known & (v.own[at] if len(v.own) else False)
                symbol = np.where(own, v.symbol[at] if len(v.symbol) else 0, 1 + h % v.classes).astype(np.int16)
                inner = np.where(own, 0.0, gain - v.log_class[h % v.classes])
                ends = first + np.arange(len(first))
                flat = np.zeros(len(h) + b - a, dtype=np.int16)
                flat[np.arange(len(h)) + T.ranges(first)] = symbol
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a),
                     T.longs(np.diff(first) + 1), T.longs(_sum(known.astype(np.int64), first) + (v.end_count > 0)),
                     pa.array(_sum(gain, first) + np.log10(v.end_count + 1.0)), pa.array(_sum(inner, first)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))],
                    names=["doc_id", "key", "held_out", "n_tokens", "known", "gain", "inner", "symbols"])
    return run


def _rare(vocabulary):
    def run(batches):
        v = vocabulary.value
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in T.texts(batch.column(1)):
                h, first = T.words(data, offsets, T.NONSPACE)
                row = T.ranges(first)
                rare = ~v.find(h.view(np.int64))[1]
                h, row = h[rare].view(np.int64), row[rare]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(fresh)
                yield pa.RecordBatch.from_arrays(
                    [T.longs(h[at]), T.longs(key[a:b][row[at]]),
                     pa.array(np.diff(np.append(at, len(h))).astype(np.int32))], names=["term", "key", "n"])
    return run


def _blocks(lists: pa.ListArray, length: int):
    """The sequences cut into blocks of at most ``length`` symbols: flat symbols, and of every block its start,
    its size, its sequence and its number there."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    off = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    off = off - off[0]
    sizes = np.diff(off)
    n = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return flat, off[:-1][row] + k * length, np.minimum(length, sizes[row] - k * length), row, k


def _longest_first(size: np.ndarray, most: int):
    """Groups of at most ``most`` blocks, longest first, each with the number of its blocks longer than t."""
    order = np.argsort(-size, kind="stable")
    for g in range(0, len(order), most):
        o = order[g:g + most]
        yield o, [int(np.searchsorted(-size[o], -t, "left")) for t in range(int(size[o[0]]))]


def _borders(A, B, pi, flat, start, size, row, k, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every block the distribution of the state before it (of the first: none), and the backward vector of
    its last symbol up to a factor, both over the whole sequence: the blocks' transfer matrices, then a pass
    over the blocks of each sequence in either direction."""
    K = len(pi)
    before, after = np.zeros((len(start), K)), np.ones((len(start), K))
    at = np.flatnonzero(np.bincount(row, minlength=1)[row] > 1)
    if not len(at):
        return before, after
    move = np.empty((len(at), K, K))
    for o, active in _longest_first(size[at], most):
        x = np.eye(K) * B[flat[start[at[o]]]][:, None, :]
        for t in range(1, len(active)):
            m = active[t]
            y = (x[:m].reshape(-1, K) @ A).reshape(m, K, K) * B[flat[start[at[o[:m]]] + t]][:, None, :]
            x[:m] = y / y.sum(axis=(1, 2), keepdims=True)
        move[o] = x
    # sequences with the most blocks first, so that those with more than i stand in front
    head = np.flatnonzero(k[at] == 0)
    n = np.diff(np.append(head, len(at)))
    o = np.argsort(-n, kind="stable")
    head, n = head[o], n[o]
    state = np.tile(pi, (len(head), 1))
    for i in range(1, int(n[0])):
        b = head[:int(np.searchsorted(-n, -i, "left"))] + i
        state = np.einsum("ni,nij->nj", state[:len(b)], move[b - 1])
        state /= state.sum(axis=1, keepdims=True)
        before[at[b]] = state
        state = state @ A
    for i in range(int(n[0]) - 2, -1, -1):
        b = head[:int(np.searchsorted(-n, -(i + 1), "left"))] + i
        z = np.einsum("nij,nj->ni", move[b + 1], after[at[b + 1]]) @ A.T
        after[at[b]] = z / z.sum(axis=1, keepdims=True)
    return before, after


def _expect(model, length: int, most: int):
    """Expected counts over whole sequences; blocks only bound what is held at a time."""
    def run(batches):
        A, B, pi, _ = model.value
        K, S = len(pi), B.shape[0]
        cA, cB, cpi, tokens, ll = np.zeros((K, K)), np.zeros(S * K), np.zeros(K), 0, 0.0
        for batch in batches:
            flat, starts, sizes, row, number = _blocks(batch.column(0), length)
            before, after = _borders(A, B, pi, flat, starts, sizes, row, number, most)
            for o, active in _longest_first(sizes, most):
                start, head, n, top = starts[o], number[o] == 0, len(o), len(active)
                last, enter = before[o], np.where(head[:, None], pi, before[o] @ A)
                alpha, emit, scale, sym = [], [], [], []
                for t in range(top):
                    m = active[t]
                    s = flat[start[:m] + t]
                    e = B[s]
                    x = (enter if t == 0 else alpha[-1][:m] @ A) * e
                    c = x.sum(axis=1)
                    alpha.append(x / c[:, None])
                    emit.append(e)
                    scale.append(c)
                    sym.append(s)
                    ll += np.log(c).sum()
                beta, gamma = after[o], [None] * top
                for t in range(top - 1, -1, -1):
                    m = active[t]
                    q = active[t + 1] if t + 1 < top else 0
                    if q:
                        weighted = emit[t + 1] * beta[:q] / scale[t + 1][:, None]
                        cA += alpha[t][:q].T @ weighted
                        beta[:q] = weighted @ A.T
                    # blocks that end here: their vector to scale, so that the states' shares add up to one
                    beta[q:m] /= (alpha[t][q:] * beta[q:m]).sum(axis=1, keepdims=True)
                    gamma[t] = alpha[t] * beta[:m]
                if top:
                    cpi += gamma[0][head].sum(axis=0)
                    cA += last[~head].T @ (emit[0] * beta / scale[0][:, None])[~head]
                    s, g = np.concatenate(sym), np.concatenate(gamma)
                    for i in range(K):
                        cB[i::K] += np.bincount(s, weights=g[:, i], minlength=S)
            tokens += int(sizes.sum())
        v = np.concatenate([(cA * A).ravel(), cB, cpi, [tokens, ll]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])
    return run


def _forward(model):
    def run(batches):
        A, B, pi, _ = model.value
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            off = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            off = off - off[0]
            size = np.diff(off)
            order = np.argsort(-size, kind="stable")
            start, size = off[:-1][order], size[order]
            out = np.zeros(len(size))
            x = None
            for t in range(int(size[0]) if len(size) else 0):
                m = int(np.searchsorted(-size, -t, "left"))
                e = B[flat[start[:m] + t]]
                x = pi * e if t == 0 else (x[:m] @ A) * e
                c = x.sum(axis=1)
                x = x / c[:, None]
                out[:m] += np.log10(c)
            back = np.empty(len(out))
            back[order] = out
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(back)],
                                             names=[*batch.schema.names[1:], "forward"])
    return run


def start_model(states: int, symbols: int, seed: int = 3) -> tuple:
    rng = np.random.default_rng(seed)
    A = rng.dirichlet(np.full(states, 5.0), states)
    B = rng.dirichlet(np.full(symbols, 5.0), states).T.copy()
    pi = np.full(states, 1.0 / states)
    return A, B, pi, pi.copy()


def parted_start(counts: np.ndarray, states: int, seed: int = 3) -> tuple:
    """A start whose states tend to stay and emit the symbols by their ``counts``, each more of some: from
    states that hardly differ, rounds gain so little at first that training would seem to have ended."""
    A, _, pi, occ = start_model(states, len(counts), seed)
    B = (np.random.default_rng(seed).gamma(1.0, size=(len(counts), states)) + 1e-3) * (counts[:, None] + 1.0)
    return (A + np.eye(states)) / 2, B / B.sum(axis=0), pi, occ


def _maximise(v: np.ndarray, states: int, symbols: int) -> tuple[tuple, float]:
    """The parameters that expected counts give, and the log likelihood per token that came with them."""
    A = v[:states * states].reshape(states, states)
    B = v[states * states:states * states + symbols * states].reshape(symbols, states)
    pi, tokens, ll = v[-states - 2:-2], v[-2], v[-1]
    occ = B.sum(axis=0) + 1e-3
    A, B, pi = A + 1e-2, B + 1e-2, pi + 1e-2
    model = (A / A.sum(axis=1, keepdims=True), B / B.sum(axis=0, keepdims=True), pi / pi.sum(), occ / occ.sum())
    return model, ll / tokens if tokens else 0.0


def _rounds(expect, model, states: int, symbols: int, rounds: int | None, tolerance: float) -> tuple[tuple, list[float]]:
    """``rounds`` rounds, or without that number as many as gain ``tolerance`` or more per token."""
    seen = []
    while len(seen) < rounds if rounds is not None else len(seen) < 2 or seen[-1] - seen[-2] >= tolerance:
        model, ll = _maximise(expect(model), states, symbols)
        seen.append(ll)
    return model, seen


def train(encoded: DataFrame, states: int = 6, symbols: int = 2048, rounds: int | None = None, length: int = 128,
          most: int = 2048, tolerance: float = 1e-3, sample: int = 400_000) -> tuple:
    """Baum-Welch over the symbol sequences of ``encoded``: (A, B by symbol, start, occupancy) and the
    log likelihood per token seen by each round. Without a number of rounds it goes on until a round gains less
    than ``tolerance`` (natural log, per token), and starts from a model trained likewise on pieces of about ``sample``
    tokens in all, which takes the many rounds that the states need to part out of the rounds over all texts."""
    sc = encoded.sparkSession.sparkContext

    def over_all(model):
        sums = arrow_map(encoded.select("symbols"), _expect(sc.broadcast(model), length, most), "i int, v double")
        got = sums.groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        v = np.zeros(states * states + symbols * states + states + 2)
        v[got["i"].to_numpy()] = got["v"].to_numpy()
        return v

    if rounds is None:
        tokens = encoded.agg(F.sum(F.size("symbols"))).first()[0] or 0
        part = F.pmod(F.xxhash64(F.lit(5), "symbols"), F.lit(1 << 20)) < min(1.0, sample / max(tokens, 1)) * (1 << 20)
        # long texts are cut into pieces of which each has the same chance, wherever it stands in its text; one of
        # equal pieces is enough for a start
        cuts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("symbols"), F.lit(1)) - 1) / PIECE).cast("int"))
        pieces = encoded.select(F.explode(F.transform(cuts, lambda i: F.slice("symbols", i * PIECE + 1, PIECE))).alias("symbols"))
        few = pieces.where(part).distinct().orderBy("symbols").toArrow().combine_chunks().to_batches()

        def over_few(model):
            return next(iter(_expect(SimpleNamespace(value=model), length, most)(few))).column(1).to_numpy()

        seen = [b.column(0).flatten().to_numpy(zero_copy_only=False) for b in few]
        counts = np.bincount(np.concatenate([*seen, np.zeros(0, np.int16)]), minlength=symbols)
        model, _ = _rounds(over_few, parted_start(counts, states), states, symbols, None, tolerance)
    else:
        model = start_model(states, symbols)
    return _rounds(over_all, model, states, symbols, rounds, tolerance)


def score(docs: DataFrame, states: int = 6, symbols: int = 2048, classes: int = 64, frequent: int = 150_000,
          rounds: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stage(arrow_map(d.where(~held_out()).select("text"), _counts, "term long, n long")
                   .groupBy("term").agg(F.sum("n").alias("c")), "word_counts")
    vocabulary = Vocabulary(counts, symbols, classes, frequent)
    shared = sc.broadcast(vocabulary)
    keyed = d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), held_out().alias("held_out"))
    encoded = stage(arrow_map(keyed, _encode(shared), "doc_id long, key long, held_out boolean, n_tokens long, known long, "
                              "gain double, inner double, symbols array<smallint>"), "encoded")
    model, _ = train(encoded.where("not held_out"), states, symbols, rounds)
    forward = arrow_map(encoded.select("symbols", "doc_id", "key", "held_out", "n_tokens", "known", "gain", "inner"),
                        _forward(sc.broadcast(model)), "doc_id long, key long, held_out boolean, n_tokens long, "
                        "known long, gain double, inner double, forward double")

    rare = arrow_map(keyed.select("key", "text"), _rare(shared), "term long, key long, n int")
    rare = (rare.join(counts, "term").groupBy("key")
            .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("more_known")))
    copies = encoded.groupBy("key").count().where("count > 1")
    out = forward.join(rare, "key", "left").join(copies, "key", "left")
    copies = F.coalesce("count", F.lit(1))
    more, known = F.coalesce("more", F.lit(0.0)) / copies, F.coalesce("more_known", F.lit(0)) / copies
    total = F.lit(float(np.log10(vocabulary.N + vocabulary.V + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + known).cast("long").alias("n_known"),
                      F.lit(vocabulary.N).cast("long").alias("train_tokens"),
                      (F.col("gain") + more - F.col("n_tokens") * total).alias("base_score"),
                      (F.col("forward") + F.col("inner") + more).alias("score"))
