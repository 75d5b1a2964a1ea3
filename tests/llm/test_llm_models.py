import math
import random
import zlib
from collections import Counter

import numpy as np
from corpus_fixture import collect, prose, spaced

from trialspark.llm import hmm, kneserney


def test_base_score_matches_plain_counts(docs, rows):
    out = collect(hmm.score(docs, states=3, symbols=64, classes=8, frequent=30, rounds=2))
    assert len(out) == len(rows)
    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2 for r in rows]
    tokens = [spaced(r[1]) + [None] for r in rows]
    c = Counter(t for w, h in zip(tokens, held) if not h for t in w)
    N, V = sum(c.values()), len(c)
    want = sorted((str(r[0]), h, len(w), sum(c[t] > 0 for t in w), N, round(sum(math.log10((c[t] + 1) / (N + V + 1)) for t in w), 6))
                  for r, h, w in zip(rows, held, tokens))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-3 for g, w in zip(got, want))
    # repeated rows and equal texts score alike
    by = {}
    for r in out:
        if r["doc_id"] is not None:
            assert abs(by.setdefault(r["doc_id"], r["score"]) - r["score"]) < 1e-9
    assert abs(by[0] - by[60]) < 1e-6 and all(r["score"] < 0 for r in out)


def test_forward_recursion_is_the_sum_over_all_state_paths():
    import itertools

    import pyarrow as pa
    model = hmm.start_model(3, 5, seed=1)
    A, B, pi, _ = model

    class Value:
        value = model
    seqs = [[0, 3, 1, 4], [2], [4, 4, 4, 0, 1], [1, 0]]
    batch = pa.RecordBatch.from_arrays([pa.array(seqs, pa.list_(pa.int16())), pa.array(range(4))], names=["symbols", "id"])
    got = [b for b in hmm._forward(Value)([batch])][0].column(1).to_pylist()
    for s, x in zip(seqs, got):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = pi[path[0]] * B[s[0], path[0]]
            for a, b, o in zip(path[:-1], path[1:], s[1:]):
                p *= A[a, b] * B[o, b]
            total += p
        assert abs(x - math.log10(total)) < 1e-9


def test_expected_counts_match_path_enumeration():
    import itertools

    import pyarrow as pa
    K, S = 2, 4
    model = hmm.start_model(K, S, seed=2)
    A, B, pi, _ = model

    class Value:
        value = model
    seqs = [[0, 3, 1], [2, 2], [1]]
    batch = pa.RecordBatch.from_arrays([pa.array(seqs, pa.list_(pa.int16()))], names=["symbols"])
    v = next(iter(hmm._expect(Value, 16, 2)([batch]))).column(1).to_numpy()
    cA, cB, cpi, ll = np.zeros((K, K)), np.zeros((S, K)), np.zeros(K), 0.0
    for s in seqs:
        paths = {}
        for path in itertools.product(range(K), repeat=len(s)):
            p = pi[path[0]] * B[s[0], path[0]]
            for a, b, o in zip(path[:-1], path[1:], s[1:]):
                p *= A[a, b] * B[o, b]
            paths[path] = p
        total = sum(paths.values())
        ll += math.log(total)
        for path, p in paths.items():
            cpi[path[0]] += p / total
            for k, o in zip(path, s):
                cB[o, k] += p / total
            for a, b in zip(path[:-1], path[1:]):
                cA[a, b] += p / total
    want = np.concatenate([cA.ravel(), cB.ravel(), cpi, [6, ll]])
    assert np.allclose(v, want)


def test_expected_counts_do_not_depend_on_the_blocks():
    import pyarrow as pa
    rng = np.random.default_rng(4)

    class Value:
        value = hmm.start_model(3, 7, seed=2)
    seqs = [rng.integers(0, 7, n).tolist() for n in (23, 1, 8, 4, 5, 12, 300, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(seqs, pa.list_(pa.int16()))], names=["symbols"])
    whole = next(iter(hmm._expect(Value, 1000, 100)([batch]))).column(1).to_numpy()
    for length, most in ((4, 3), (1, 5), (7, 100)):
        assert np.allclose(next(iter(hmm._expect(Value, length, most)([batch]))).column(1).to_numpy(), whole)


def test_production_model_beats_the_unigram(spark):
    from pyspark.sql import functions as F

    from trialspark.llm.staging import arrow_map, stage
    # words of either half follow each other, so that a state for each half gains ln 2 a word
    rng = random.Random(8)
    halves = [[f"{h}{i}" for i in range(150)] for h in "ab"]
    rows = [(i, " ".join(rng.choice(halves[(i + j // 40) % 2]) for j in range(400))) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.lit(False).alias("held_out"))
    counts = stage(arrow_map(d.select("text"), hmm._counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("c")), "t")
    v = spark.sparkContext.broadcast(hmm.Vocabulary(counts, 2048, 64, 150_000))
    enc = stage(arrow_map(d, hmm._encode(v), "doc_id long, key long, held_out boolean, n_tokens long, known long, gain double, "
                          "inner double, symbols array<smallint>"), "t")
    _, seen = hmm.train(enc)
    n = np.array(list(Counter(x for r in enc.select("symbols").collect() for x in r.symbols).values()))
    assert seen[-1] > (n * np.log(n / n.sum())).sum() / n.sum() + 0.3
    assert len(seen) >= 2 and seen[-1] - seen[-2] < 1e-3


def test_training_raises_the_likelihood(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("the", "a")) + " " + rng.choice(("cat", "dog", "sun")) for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    d = df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) as key", "false as held_out")
    from trialspark.llm.staging import arrow_map, stage
    counts = stage(arrow_map(d.select("text"), hmm._counts, "term long, n long").groupBy("term").sum("n").withColumnRenamed("sum(n)", "c"), "t")
    v = spark.sparkContext.broadcast(hmm.Vocabulary(counts, 32, 4, 10))
    enc = stage(arrow_map(d, hmm._encode(v), "doc_id long, key long, held_out boolean, n_tokens long, known long, gain double, "
                          "inner double, symbols array<smallint>"), "t")
    _, seen = hmm.train(enc, 2, 32, 8)
    assert all(b >= a - 1e-3 for a, b in zip(seen[1:], seen[2:])) and seen[-1] > seen[0] + 0.3


def test_empty_training(spark, no_docs):
    assert collect(hmm.score(no_docs)) == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    out = collect(hmm.score(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string"), rounds=1))
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out] == [(3, 0, 0, 0.0)] * 3


def plain_kneser_ney(texts):
    """p(w | a, b) by dictionaries."""
    tri = Counter()
    for t in texts:
        s = [kneserney.LINE] * 2 + [int(kneserney._FOLD[x]) for x in t.encode()]
        tri.update(zip(s, s[1:], s[2:]))
    bi = Counter((b, w) for _, b, w in tri)
    uni = Counter(w for _, w in bi)

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(1, 5)]
        out = []
        for k, default in enumerate((0.5, 0.75, 0.9)):
            x = k + 1 - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k + 1] / n[k] if n[0] and n[k] else default
            out.append(x if 0 < x < k + 1 else default)
        return out

    def level(c, context):
        d = discounts(c)
        cut = lambda v: d[min(v, 3) - 1] if v else 0.0
        total, freed = Counter(), Counter()
        for g, v in c.items():
            total[context(g)] += v
            freed[context(g)] += cut(v)
        return lambda g, low: ((c[g] - cut(c[g]) + freed[context(g)] * low) / total[context(g)] if total[context(g)] else low)
    one, two, three = level(uni, lambda g: 0), level(bi, lambda g: g[0]), level(tri, lambda g: g[:2])
    return lambda a, b, w: three((a, b, w), two((b, w), one(w, 1 / kneserney.SYMBOLS)))


def test_model_matches_plain_kneser_ney_and_sums_to_one(spark):
    rng = random.Random(3)
    texts = [prose(rng, "en", 30) for _ in range(12)]
    model = kneserney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = {r.code: math.exp(r.logp) for r in model.collect()}
    n = kneserney.SYMBOLS
    assert len(p) == n ** 3
    want = plain_kneser_ney(texts)
    for _ in range(500):
        a, b, w = rng.randrange(n), rng.randrange(n), rng.randrange(n)
        assert abs(p[(a * n + b) * n + w] - want(a, b, w)) < 1e-9
    for t in ((1, 1), (20, 9), (0, 5)):
        assert abs(sum(p[(t[0] * n + t[1]) * n + w] for w in range(n)) - 1) < 1e-9


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        bad = i % 12 == 0
        t = prose(rng, lang, 80)
        rows.append((i, " | ".join(t.upper().split()) if bad else t, lang))
        if i < 180:
            labels.append((i, 0 if bad else 1, 0))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, kept string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in collect(kneserney.classify(df, lab, quantile=0.99))}
    assert len(out) == 240
    assert not any(out[i]["kept"] for i in range(0, 240, 12))
    clean = [out[i]["kept"] for i in range(180, 240) if i % 12]
    assert sum(clean) >= 0.93 * len(clean)


def test_quality_hard_cases(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    out = collect(kneserney.classify(docs, labels))
    assert len(out) == len(rows)
    assert all(r["perplexity"] is None and not r["kept"] for r in out if r["doc_id"] in (100, 101, 108))
    assert collect(kneserney.classify(no_docs, labels)) == []
    free = collect(kneserney.classify(docs, labels.limit(0)))
    assert all(r["kept"] == (r["perplexity"] is not None) for r in free)
