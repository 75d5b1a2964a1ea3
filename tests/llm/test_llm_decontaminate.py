import random

import pyarrow as pa
from corpus_fixture import alnum, collect, prose

from trialspark.llm import decontaminate
from trialspark.llm.text import hash_of


def brute(rows, items, window=10):
    out = {}
    for d, t, *_ in rows:
        w, hit, found = alnum(t), set(), set()
        for item_id, text in items:
            g = alnum(text)
            n = min(window, len(g))
            for i in range(len(g) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == g[i:i + n]:
                        hit |= set(range(p, p + n))
                        found.add(item_id)
        out[d] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def fixture():
    rng = random.Random(9)
    items = [(i, prose(rng, "en", rng.choice((4, 9, 10, 15, 40)))) for i in range(12)]
    items += [(12, "the the the the the the the the the the the the"), (13, None), (14, " ... "), (15, "lonely"),
              (3, items[3][1]), (None, items[4][1])]
    rows = []
    for i in range(60):
        t = prose(rng, "en", 40).split(" ")
        if i % 2:
            w = (items[i % 12][1] or "").upper().split(" ")
            a = rng.randrange(len(w))
            part = w if i % 3 else w[a:a + rng.randint(5, 14)]
            p = rng.randrange(len(t))
            t[p:p] = part
        if i % 7 == 0:
            t += ["THE"] * rng.randint(8, 25)
        rows.append((i, ", ".join(t)))
    rows += [(60, None), (61, ""), (62, "Lonely"), (63, items[5][1]), (63, items[5][1]), (64, items[0][1] + " " + items[0][1])]
    return rows, items


def test_hits_match_brute_force(spark):
    rows, items = fixture()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, term string, pos string").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, m int")
    out = collect(decontaminate.decontaminate(df, bench))
    assert len(out) == len(rows)
    want = brute(rows, items)
    for r in out:
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]], r["doc_id"]
        assert r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"])
        assert r["n_near_items"] >= r["n_items"]


def test_proximity_finds_one_changed_word(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    near = item.replace("echo", "other")
    far = near.replace("golf", "other")
    rows = [(1, "x " + item), (2, "y " + near), (3, far), (4, item[6:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in collect(decontaminate.decontaminate(df, bench))}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 1)}


def test_hard_cases(spark, docs, rows, no_docs):
    bench = spark.createDataFrame([(1, rows[5][1]), (2, None)], "item_id long, text string")
    out = collect(decontaminate.decontaminate(docs, bench))
    assert len(out) == len(rows)
    null = sorted((r["n_words"], r["n_hit"] > 0) for r in out if r["doc_id"] is None)
    assert null[0] == (0, False) and null[1][1]  # known by its text
    assert {r["doc_id"] for r in out if r["contaminated"]} >= {5, 65}
    assert collect(decontaminate.decontaminate(no_docs, bench)) == []
    assert all(not r["contaminated"] for r in collect(decontaminate.decontaminate(docs, bench.limit(0))))


def test_postings_leave_the_worker_in_slices():
    """A run of 2^20 postings left in one batch before, 21 MB at once in the executor's native memory."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    texts = [" ".join(words[a:a + 50_000]) for a in (0, 50_000, 100_000)] + [None]
    out = list(decontaminate._postings([pa.RecordBatch.from_arrays([pa.array([7, 8, 9, None]), pa.array(texts)], names=["doc_id", "text"])]))
    assert max(b.num_rows for b in out) <= decontaminate.SLICE_WORDS < len(words) // 2
    lengths = [r for b in out for r in b.to_pylist() if r["term"] is None]
    assert [r["pos"] for r in lengths] == [50_000] * 3 + [0] and [r["named"] for r in lengths] == [True] * 3 + [False]
    run = [r for b in out for r in b.to_pylist() if r["term"] is not None]
    assert [r["term"] for r in run] == sorted(r["term"] for r in run)
    want = {w: hash_of(w) for w in set(words)}
    assert sorted((r["doc"], r["pos"], r["term"]) for r in run) == [
        (7 + i // 50_000, i % 50_000, want[w]) for i, w in enumerate(words)]
