import random

from corpus_fixture import classes, collect
from pyspark.sql import functions as F

from trialspark.llm import lines, staging


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, a, most, alphabet):
    b = list(a)
    for _ in range(rng.randint(0, most)):
        r = rng.random()
        if b and r < 0.4:
            b.pop(rng.randrange(len(b)))
        elif b and r < 0.7:
            b[rng.randrange(len(b))] = rng.choice(alphabet)
        else:
            b.insert(rng.randint(0, len(b)), rng.choice(alphabet))
    return "".join(b)


def test_banded_distance_matches_levenshtein(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 14) if i % 3 else rng.randint(30, 60)))
        rows.append((i, a, edited(rng, a, 4, "abé😀")))
    df = spark.createDataFrame(rows, "id long, x string, y string")
    for t in (1, 2, 3):
        want = {i for i, a, b in rows if distance(a, b) <= t}
        assert {r.id for r in lines.within_distance(df, t).collect()} == want


def brute(rows, most, min_chars):
    """doc_id -> (lines, dropped, text)"""
    occurs = [(d, p, s) for d, t, *_ in rows if d is not None and t is not None for p, s in enumerate(t.split("\n"))
              if len(s) >= min_chars]
    occurs = sorted(set(occurs))
    texts = sorted({s for *_, s in occurs})
    up = {s: s for s in texts}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if abs(len(a) - len(b)) <= most and sum((x != y) for x, y in zip(a[:most + 1], b)) <= most + 1 and distance(a, b) <= most:
                up[root(a)] = root(b)
    first, gone = {}, set()
    for d, p, s in occurs:
        if first.setdefault(root(s), (d, p)) != (d, p):
            gone.add((d, p))
    out = {}
    for d, t, *_ in rows:
        if d is not None:
            left = None if t is None else "\n".join(s for p, s in enumerate(t.split("\n")) if (d, p) not in gone)
            out[d] = (len(t.split("\n")) if t else 0, sum(x == d for x, _ in gone), left)
    return out


def test_kept_lines_match_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(15, 40))) for _ in range(40)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), 3, "abcde ") for _ in range(rng.randint(1, 6)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 2):
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in collect(lines.dedup_lines(df, most, 18))}
        assert got == brute(rows, most, 18)


def test_hard_cases(spark, docs, rows, no_docs):
    out = collect(lines.dedup_lines(docs))
    assert len(out) == len(rows) and set(out[0]) == set(docs.columns) | {"n_lines", "n_dropped"}
    small = [r for r in rows if r[0] is not None and len(r[1] or "") < 5000]
    want = brute(small, 2, 20)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in out}
    assert all(got[d] == want[d] for d, *_ in small)
    assert got[106][1:] == (0, "word " * 30_000) and got[100] == (0, 0, None) and got[101] == (0, 0, "")
    assert sorted(str(r["text"])[:5] for r in out if r["doc_id"] is None) == sorted(str(t)[:5] for d, t, *_ in rows if d is None)
    assert collect(lines.dedup_lines(no_docs)) == []


def test_short_equal_lines_go_in_the_pipeline(spark):
    import corpus_pipeline
    rows = [(1, "Les.\nNt onor.\n---"), (2, "Les.\n---\n\nLos."), (3, "\nles.\nNt onor.\nLes."), (4, "Les."), (None, "Les.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["text"] for r in collect(lines.dedup_lines(df))} == {t for _, t in rows}
    got = {r["doc_id"]: r["text"] for r in collect(corpus_pipeline.line_dedup(spark, df, ""))}
    assert got == {1: rows[0][1], 2: "---\n\nLos.", 3: "\nles.", None: "Les."}


def test_main_path_is_native(spark, docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_segments_cover_a_line(spark):
    for k in (2, 3, 4):
        t = spark.range(k, 40).select("id", lines.shape(F.col("id").cast("int"), 0, k).alias("t"))
        got = t.select("id", *[F.struct(*[c.alias(x) for c, x in zip(lines.segment(F.col("t"), i), "sn")])
                               .alias(f"g{i}") for i in range(k)]).collect()
        for r in got:
            at = 1
            for i in range(k):
                assert r[f"g{i}"].s == at
                at += r[f"g{i}"].n
            assert at == r.id + 1


def test_digits_left_meet_within_the_distance(spark):
    """Strings of digits within two edits share what is left of them; few others do."""
    rng = random.Random(6)
    rows = ["", "1", "12", "0123456789" * 2] + ["".join(rng.choice("0123456789") for _ in range(rng.randrange(3, 19))) for _ in range(150)]
    near = []
    for s in list(rows):
        t = list(s)
        for _ in range(2):
            k = rng.randrange(3)
            at = rng.randrange(len(t) + (k == 0)) if t or k == 0 else 0
            if k == 0:
                t.insert(at, rng.choice("0123456789"))
            elif t and k == 1:
                t[at] = rng.choice("0123456789")
            elif t:
                t.pop(at)
        near.append((s, "".join(t)))
    df = spark.createDataFrame(near, "a string, b string")
    got = df.select("a", "b", F.arrays_overlap(lines.digits_left(F.col("a"), 2), lines.digits_left(F.col("b"), 2)).alias("meet")).collect()
    assert all(r.meet for r in got)
    mixed = [(a, b) for (a, _), (b, _) in zip(near, near[1:]) if 5 < len(a) <= 14 and 5 < len(b) <= 14]
    far = spark.createDataFrame(mixed, "a string, b string").select(
        F.arrays_overlap(lines.digits_left(F.col("a"), 2), lines.digits_left(F.col("b"), 2)).alias("meet")).collect()
    assert sum(r.meet for r in far) < 0.3 * len(far)


def test_numbered_lines_do_not_make_all_pairs(spark, monkeypatch):
    """Lines that differ in a number only: pairs that are looked at stay near the links, and no link is lost."""
    rng = random.Random(7)
    numbers = rng.sample(range(10 ** 6), 700)
    numbers += [n + 1 for n in numbers[:60]]
    text = {i: f"Archive record number {n:06d} of the collection" for i, n in enumerate(dict.fromkeys(numbers))}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(4)
    kept = {}
    monkeypatch.setattr(lines, "stage", lambda d, name, *a: kept.setdefault(name, staging.stage(d, name, *a)))
    out = {r["doc_id"]: r["n_dropped"] for r in collect(lines.dedup_lines(df))}
    ids, number = list(text), {i: t.split()[3] for i, t in text.items()}  # the wording is the same on both sides
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if distance(number[a], number[b]) <= 2]
    component = classes(ids, links)
    assert out == {i: int(component[i] != i) for i in ids}
    assert kept["crowded_keys"].count() > 0
    assert len(links) <= kept["line_pairs"].count() < 20 * len(links) < len(ids) * (len(ids) - 1) / 2
