"""The registered queries against their SQL and against plain versions, and the pipeline as a whole."""

import os

import corpus_pipeline
import duckdb
import pytest
from corpus_fixture import alnum, classes, collect, spaced

from trialspark.llm import kneserney, langid, queries

SF = "/root/testdata/sf0.001"
NEEDS = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@NEEDS
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(cols, res.fetchall())


def test_every_operator_has_one_query():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))


@NEEDS
def test_language_accuracy_on_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in queries.op7_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(out) > 200 and sum(docs[r.doc_id] == r.lang_pred for r in out) >= 0.98 * len(out)


@NEEDS
def test_quality_rejects_labelled_junk_and_keeps_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {r.doc_id: r.kept for r in queries.op4_quality_classifier(spark, sf).collect()}
    junk = [out[d] for d, q in quality.items() if q == 0]
    good = [out[d] for d, q in quality.items() if q == 1]
    assert sum(junk) <= 0.15 * len(junk) and sum(good) >= 0.97 * len(good)
    assert kneserney.SYMBOLS == 64


def plain_pipeline(rows, items, languages):
    """(doc_id, text) left before the mix, by plain loops."""
    from test_llm_decontaminate import brute as leaks
    from test_llm_lines import brute as lines
    rows = [r for r in rows if languages[r[0]] != langid.UNDETERMINED]
    cleaned = lines(rows, 2, 20)
    rows = [[r[0], cleaned[r[0]][2], *r[2:]] for r in rows if not (cleaned[r[0]][1] and not cleaned[r[0]][2].strip())]
    sets = {}
    for r in rows:
        w = spaced(r[1])
        sets[r[0]] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = classes(ids, links)
    rows = [r for r in rows if first[r[0]] == r[0]]
    hit = leaks(rows, items)
    return [r for r in rows if hit[r[0]][1] == 0]


def test_pipeline_matches_plain_version(spark, tmp_path, rows):
    from test_llm_mixing import brute_taken
    own = [list(r) for r in rows if r[0] is not None and len(r[1] or "") < 5000]
    own = [r for i, r in enumerate(own) if r[0] not in {x[0] for x in own[:i]}]
    items = [(0, own[30][1].replace("\n", " ")), (1, "nothing of this kind occurs in any of these documents at all")]
    spark.createDataFrame([tuple(r) for r in own], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    languages = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()}
    left = plain_pipeline(own, items, languages)
    assert 30 not in {r[0] for r in left} and 30 < len(left) < len(own)
    want = {d: t for d, *_, t in brute_taken(left) if t}
    out = collect(corpus_pipeline.run(spark, str(tmp_path)))
    got = {}
    for r in out:
        got[str(r["doc_id"])] = got.get(str(r["doc_id"]), 0) + r["taken"]
    assert got == want
    text = {str(r[0]): r[1] for r in left}
    assert all(alnum(r["text"]) == alnum(text[str(r["doc_id"])])[:len(alnum(r["text"]))] for r in out)


def test_stages_keep_columns_and_take_hard_rows(spark, tmp_path, docs, no_docs, rows):
    spark.createDataFrame([(1, rows[5][1]), (2, None), (None, "")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    one, none = docs, no_docs
    for name, stage in corpus_pipeline.STAGES:
        one, none = stage(spark, one, str(tmp_path)), stage(spark, none, str(tmp_path))
        assert none.count() == 0, name
        if name != "source_mix":
            assert one.columns == docs.columns, name
    # a null id is never dropped for its copy, but a repeated row is
    ids = [r.doc_id for r in one.select("doc_id").collect()]
    assert ids.count(7) <= 2 and 60 not in ids and 5 not in ids
