import hashlib
import random
import zlib

import pytest
from corpus_fixture import CLASH, collect
from pyspark.sql import functions as F

from trialspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][a:a + 3]) for a in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i - i % 3
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 3])))
        i //= 3
    return out


def postorder(tree):
    """Nodes as they are complete, by a plain recursion from the top."""
    out = []

    def visit(level, i):
        if level:
            for c in range(3 * i, min(3 * i + 3, len(tree[level - 1]))):
                visit(level - 1, c)
        out.append(tree[level][i])
    visit(len(tree) - 1, 0)
    return out


def brute(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    whole = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = siblings(trees[s], i) + siblings(whole, k)
            d = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                d = leaf([*r[:4], tampered(r[4])])
            for a, b in path:
                d = h(a, d, b)
            out.append((r[0], own, trees[s][-1][0], whole[-1][0], "".join(a + b for a, b in path), d, d == whole[-1][0]))
    return sorted(out, key=str), trees, whole


def manifest(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).select("*", *[F.lit(1).alias(c) for c in [*CLASH, "tree", "digest", "n_", "root", "leaf"]
                                                                         if c not in ("doc_id", "source")])
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", ""))
    out, groups, whole = merkle.manifest(df, changed)
    cols = ["id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in collect(out)), key=str), groups, whole


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, rng.choice(["en", None]), rng.choice([None, 7, -3]), rng.choice(["", "a\nb", "zeile\nä語\n", None, "plain"])))
            i += 3
    rng.shuffle(rows)
    return rows


def test_position_is_postorder():
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 100]:
        tree = levels([str(i) for i in range(n)])
        order = postorder(tree)
        at = [order[merkle.position(k, i, n)] for k, nodes in enumerate(tree) for i in range(len(nodes))]
        assert at == [x for nodes in tree for x in nodes]
        assert merkle.append_log([str(i) for i in range(n)], merkle.height(n)) == order


def test_manifest_matches_plain_trees(spark):
    # one hot source over several rounds of builders, and trees of one, two and three leaves
    rows = rows_of({"hot": 700, None: 4, "": 1, "a": 2, "b": 3, "é": 10, "Z": 82, "z z": 81})
    want, trees, whole = brute(rows, lambda t: t.replace("\n", ""))
    got, groups, root = manifest(spark, rows)
    assert got == want
    assert len({r[-1] for r in got}) == 2
    assert len(groups.rounds) == 2
    # the log holds every node once, at its postorder place, and proofs can be read from it by address
    log = {}
    for r in collect(groups.log()):
        log.setdefault(r["tree"], {})[r["position"]] = r["digest"]
    for s, tree in trees.items():
        name = "" if s is None else "=" + s
        order = postorder(tree)
        assert [log[name][i] for i in range(len(order))] == order and len(log[name]) == len(order)
        for i in range(0, len(tree[0]), 7):
            read = [("".join(log[name][p] for p in a), "".join(log[name][p] for p in b)) for a, b in merkle.addresses(i, len(tree[0]))]
            assert read == siblings(tree, i)


def test_many_sources(spark):
    rows = rows_of({f"s{i:04d}": 1 for i in range(300)})
    assert manifest(spark, rows)[0] == brute(rows, lambda t: t.replace("\n", ""))[0]


@pytest.mark.parametrize("rows", [
    [], [(1, None, None, None, None)], [(None, None, None, None, None)] * 4,
    [(5, "a", "x", 1, "same")] * 200 + [(5, "a", "x", 2, "other"), (None, "a", None, None, "\n"), (None, "a", None, None, "")],
    [(1, "a", "en", 10 ** 6, "long\n" * 400_000), (2, "a", "en", 0, "")],
])
def test_hard_cases(spark, rows):
    assert manifest(spark, rows)[0] == brute(rows, lambda t: t.replace("\n", ""))[0]
