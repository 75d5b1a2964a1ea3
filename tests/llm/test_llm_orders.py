"""The quality model counts n-grams of order five in tables that grow with the corpus (finding of round 4)."""

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from corpus_fixture import collect, prose

from trialspark.llm import kneserney, text
from trialspark.llm.staging import stage


def grams(t, order):
    s = b"\n" * (order - 1) + (t or "").encode()
    return [s[i:i + order] for i in range(len(s) - order + 1)]


def plain(texts, order):
    """p(last byte | the bytes before) by dictionaries."""
    levels = [Counter(g for t in texts for g in grams(t, order))]
    while len(levels) < order:
        levels.append(Counter(g[1:] for g in levels[-1]))
    tables = []
    for c in levels:
        n = [sum(v == k for v in c.values()) for k in range(1, 5)]
        d = [0.0]
        for k, default in enumerate((0.5, 0.75, 0.9)):
            x = k + 1 - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k + 1] / n[k] if n[0] and n[k] else default
            d.append(x if 0 < x < k + 1 else default)
        total, freed = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3)]
        tables.append((c, d, total, freed))

    def p(g):
        q = 1 / 256
        for i in range(len(g) - 1, -1, -1):
            c, d, total, freed = tables[order - len(g) + i]
            h = g[i:]
            q = (c[h] - d[min(c[h], 3)] + freed[h[:-1]] * q) / total[h[:-1]] if total[h[:-1]] else q
        return q
    return p


def plain_perplexity(t, p, order):
    return math.exp(-sum(math.log(p(g)) for g in grams(t, order)) / len(t.encode())) if t else None


def code(g):
    return int.from_bytes(g, "big")


def test_perplexities_are_those_of_a_plain_model_of_order_five(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, ("en", "de")[i % 2], 40), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (102, rows[3][1], "x"), (None, "ÿ é 世界 0", None), (3, rows[3][1], "x")]
    rows += [(103, "aba" * 30, "x"), (104, rows[5][1][::-1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    out = collect(kneserney.classify(df, labels))
    trained = [t for i, t, _ in rows if i is not None and i < 50 and zlib.crc32(str(i).encode()) % 2 == 0]
    p = plain(trained, 5)
    assert len(out) == len(rows)
    text_of = dict((i, t) for i, t, _ in rows)
    for r in out:
        want = plain_perplexity(text_of[r["doc_id"]], p, 5)
        assert r["n"] == len((text_of[r["doc_id"]] or "").encode())
        assert r["perplexity"] is None if want is None else abs(r["perplexity"] - want) < 1e-9 * want


def test_probabilities_of_a_context_sum_to_one_at_every_order(spark):
    texts = ["ab abc abcd abcde", "abcde abcdf", "bcd"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for order in (1, 2, 4, 7):
        contexts = {g[:-1] for t in texts for g in grams(t, order)} | {b"zzzzzzz"[:order - 1]}
        codes = spark.createDataFrame([(code(c + bytes([b])),) for c in contexts for b in range(256)], "code long")
        got = {r.code: math.exp(r.logp) for r in kneserney.train(df, kneserney.BYTES, codes, order).collect()}
        p = plain(texts, order)
        for c in contexts:
            assert abs(sum(got[code(c + bytes([b]))] for b in range(256)) - 1) < 1e-9
            assert all(abs(got[code(c + bytes([b]))] - p(c + bytes([b]))) < 1e-9 for b in (97, 98, 10, 255))


def batches(texts, size):
    return [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(i, i + len(x)), pa.int64()), "lang": pa.array(["x"] * len(x)),
                                        "text": pa.array(x, pa.string())})
            for i in range(0, len(texts), size) for x in [texts[i:i + size]]]


def test_counts_passed_on_early_and_texts_in_pieces_sum_to_the_same(monkeypatch):
    rng = random.Random(6)
    texts = [None, "", *[prose(rng, "en", 60) for _ in range(20)], prose(rng, "de", 400)]
    want = Counter(code(g) for t in texts for g in grams(t, 5))
    monkeypatch.setattr(kneserney, "HELD", 300)
    monkeypatch.setattr(kneserney, "SLICE", 64)
    monkeypatch.setattr(text.texts, "__defaults__", (700,))
    monkeypatch.setattr(text, "CHUNK_BYTES", 700)
    sent = list(kneserney._count_batches(kneserney.BYTES, 5)(b.select(["text"]) for b in batches(texts, 4)))
    got = Counter()
    for b in sent:
        assert len(b) <= 64
        for c, n in zip(*(x.to_pylist() for x in b.columns)):
            got[c] += n
    assert got == want and sum(len(b) for b in sent) > len(want)


def test_a_unit_ends_when_its_text_or_its_grams_are_full_and_holds_each_gram_once(monkeypatch):
    rng = random.Random(7)
    texts = [prose(rng, "en", 60) for _ in range(30)]
    for name, most in (("UNIT_BYTES", 2000), ("HELD", 400)):
        with monkeypatch.context() as m:
            m.setattr(kneserney, name, most)
            found = [b.to_pylist()[0] for b in kneserney._unit_batches(kneserney.BYTES, 5)(iter(batches(texts, 2)))]
        units = sorted({x["unit"] for x in found})
        assert len(units) > 3
        read = []
        for u in units:
            own = [x for x in found if x["unit"] == u]
            inside = [t for x in own for b in kneserney._unpacked(x["rows"]) for t in b.column(2).to_pylist()]
            got = kneserney._unit_codes((u,), pa.table({"codes": pa.array([x["codes"] for x in own], pa.binary())}))
            assert Counter(got["code"].to_pylist()) == Counter({code(g) for t in inside for g in grams(t, 5)})
            read += inside
        assert read == texts


def test_scores_do_not_depend_on_the_pieces(monkeypatch):
    rng = random.Random(9)
    texts = [None, prose(rng, "en", 300), "", prose(rng, "de", 20)]
    weight = {code(g): rng.random() - 2 for t in texts for g in grams(t, 5)}
    mixed = rng.sample(sorted(weight), len(weight))
    weights = pa.table({"code": pa.array(mixed, pa.int64()), "logp": pa.array([weight[c] for c in mixed])})
    rows = pa.table({"rows": pa.array([kneserney._packed(b) for b in batches(texts, 3)], pa.binary())})
    monkeypatch.setattr(text.texts, "__defaults__", (500,))
    monkeypatch.setattr(text, "CHUNK_BYTES", 500)
    got = kneserney._unit_scores(kneserney.BYTES, 5)(rows, weights).to_pylist()
    for r, t in zip(got, texts, strict=True):
        assert r["n"] == len((t or "").encode())
        assert r["perplexity"] is None if not t else abs(
            math.log(r["perplexity"]) + sum(weight[code(g)] for g in grams(t, 5)) / r["n"]) < 1e-9
    with pytest.raises(RuntimeError, match="without a probability"):
        kneserney._unit_scores(kneserney.BYTES, 5)(rows, weights.slice(1))


def test_scoring_broadcasts_no_model_and_units_are_shuffled_once(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, prose(rng, "en", 80), "x") for i in range(40)], "doc_id long, text string, lang string")
    df = stage(df, "docs")
    codes = stage(kneserney._counts(df, kneserney.BYTES, 5).select("code"), "codes")
    model = kneserney.train(df, kneserney.BYTES, codes, 5)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = kneserney.perplexities(df, model, kneserney.BYTES, 5)
        assert len(found.collect()) == 40
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    plan = plan.split("Initial Plan")[0]  # what ran
    assert "Broadcast" not in plan and "ReusedExchange" in plan
