from corpus_fixture import classes, collect, spaced

from trialspark.llm import minhash


def sets(rows, k):
    out = []
    for doc_id, text, *_ in rows:
        w = spaced(text)
        out.append((doc_id, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def brute(rows, k):
    s = [(d, x) for d, x in sets(rows, k) if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(s) for b, y in s[:i]
             if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return classes({d for d, _ in s}, links)


def test_classes_match_brute_force(docs, rows):
    for k in (2, 5):
        got = collect(minhash.near_duplicates(docs, k=k))
        want, size = brute(rows, k), dict((d, len(x)) for d, x in sets(rows, k) if d is not None)
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is not None:
                assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == size[r["doc_id"]]
                assert r["kept"] == (r["component_id"] == r["doc_id"])
        # a null id takes part through its text
        assert sorted((r["component_id"] is None, r["kept"]) for r in got if r["doc_id"] is None) == [(False, False), (True, True)]


def test_empty_table(no_docs):
    assert collect(minhash.near_duplicates(no_docs)) == []


def test_many_near_copies_are_one_class_without_all_pairs(spark):
    import random
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    got = collect(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2))
    want = brute([(i, t) for i, t in rows], 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_sketches_fill_and_estimate():
    import numpy as np
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2 ** 63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[600:3600])
    flat, ends = np.concatenate([a, b, a[:1]]), np.array([0, 3000, 6000, 6001])
    s = minhash.sketches(flat, ends, 1024)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 2400 / 3600) < 0.06
