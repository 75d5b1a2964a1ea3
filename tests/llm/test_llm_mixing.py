import hashlib
import random

from corpus_fixture import collect, spaced
from pyspark.sql import functions as F

from trialspark.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        t = {s: most * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if t[s] > most * sizes[s]}
        if not over:
            return t
        full |= over


def brute_taken(rows, seed=17):
    size = [len(spaced(t)) for _, t, *_ in rows]
    sizes = {}
    for r, n in zip(rows, size):
        sizes[r[3]] = sizes.get(r[3], 0) + n
    targets = brute_targets(sizes)
    taken = [0] * len(rows)
    for s in sizes:
        mine = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (
            hashlib.md5(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(),
            rows[i][0] is not None, rows[i][0] or 0, size[i]))
        at = 0
        for p in range(2):
            for i in mine:
                taken[i] += max(0, min(round(targets[s]) - at, size[i]))
                at += size[i]
    return sorted(zip([str(r[0]) for r in rows], size, [sizes[r[3]] for r in rows],
                      [round(targets[r[3]], 6) for r in rows], taken))


def test_taken_words_match_brute_force(docs, rows):
    mixed = mixing.mix(docs, shards=8)
    out = collect(mixed.drop("draws"))
    got = sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in out)
    assert got == brute_taken(rows)
    assert set(mixed.columns) == set(docs.columns) | {"size", "source_size", "target", "taken", "draws"}


def test_shards_draw_disjoint_blocks_of_equal_number(docs):
    drawn = mixing.mix(docs, shards=8).select("source", F.explode("draws").alias("d")).select("source", "d.*")
    rows = collect(drawn)
    assert len({(r["source"], r["block"]) for r in rows}) == len(rows)
    n = [sum(r["shard"] == k for r in rows) for k in range(8)]
    assert max(n) - min(n) <= 8 and all(0 <= r["shard"] < 8 for r in rows)


def test_mix_is_whole_texts_but_the_last_block_of_a_source(docs):
    mixed = mixing.mix(docs, shards=4)
    out = collect(mixing.blocks(mixed, docs.columns))
    assert all(len(spaced(r["text"])) == r["taken"] for r in out)
    total = {}
    for r in out:
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
    want = {r["source"]: round(r["target"]) for r in collect(mixed.select("source", "target").distinct())}
    assert all(abs(total.get(s, 0) - t) <= 1 for s, t in want.items())
    assert collect(mixing.blocks(mixing.mix(docs, shards=4), docs.columns)) and sorted(map(str, out)) == sorted(
        map(str, collect(mixing.blocks(mixing.mix(docs, shards=4), docs.columns))))


def test_empty_and_wordless_tables(spark, no_docs):
    assert collect(mixing.mix(no_docs)) == []
    none = spark.createDataFrame([(1, None, "a"), (2, "  ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in collect(mixing.mix(none))] == [(0.0, 0)] * 2


def test_main_path_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_hypergeometric_draws():
    rng = random.Random(3)
    got = [mixing.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert min(got) >= 0 and max(got) <= 20
    mean = sum(got) / len(got)
    var = sum((x - mean) ** 2 for x in got) / len(got)
    assert abs(mean - 6) < 0.1 and abs(var - 20 * 0.3 * 0.7 * 80 / 99) < 0.2
    big = mixing.hypergeometric(rng, 10 ** 11, 3 * 10 ** 11, 10 ** 8)
    assert abs(big - 25_000_000) < 50_000
    assert mixing.hypergeometric(rng, 5, 0, 3) == 3 and mixing.hypergeometric(rng, 0, 5, 3) == 0


def test_splitting_tree_keeps_quotas():
    for shards in (1, 3, 8, 13):
        tree = mixing.splitting_tree([100, 0, 37, 5], shards, 1)
        assert len(tree) == shards and [sum(c) for c in zip(*tree)] == [100, 0, 37, 5]
        assert max(map(sum, tree)) - min(map(sum, tree)) <= shards.bit_length()


def test_shards_meet_and_cut_texts_keep_their_lines(spark):
    from pyspark.sql import functions as F
    rows = [(i, f"\n a{i} b{i}\n\nc{i}\td{i} \n e{i} ", f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.blocks(mixing.mix(df), df.columns)
    got = out.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")).collect()
    tasks = {}
    for r in got:
        tasks.setdefault((r.shard, r.shuffle % 8), set()).add(r.task)
    assert len(got) > 300 and all(len(t) == 1 for t in tasks.values())
    by = {}
    for r in sorted(got, key=lambda r: r["at"]):
        by.setdefault(r.task, []).append((r.shard, r.shuffle))
    assert all(x == sorted(x) for x in by.values())
    full = {i: t for i, t, _ in rows}
    cut = [r for r in got if r.taken < 5]
    assert cut
    for r in got:
        assert full[r.doc_id].startswith(r.text) and len(r.text.split()) == r.taken
