import random
import zlib

from corpus_fixture import WORDS, collect, prose

from pyspark.sql import functions as F

from trialspark.llm import langid


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(5, 60)), lang) for i in range(300) for lang in [rng.choice(list(WORDS))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = collect(langid.identify(df, langid.fit(df)))
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 60 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_labels_and_sources_of_a_document_do_not_change_its_prediction(docs):
    model = langid.fit(docs)
    a = collect(langid.identify(docs.select("doc_id", "text"), model))
    b = collect(langid.identify(docs, model))
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"]), r["lang_pred"], r["score"]) for r in rows)
    assert key(a) == key(b)


def test_held_out_rows_are_not_learned(spark, docs):
    held = docs.where(langid.held_out())
    assert held.count() and langid.fit(held)["langs"] == []


def test_hard_cases(docs, rows, no_docs):
    out = collect(langid.identify(docs, langid.fit(docs)))
    assert len(out) == len(rows) and set(out[0]) == set(docs.columns)
    und = {r["doc_id"] for r in out if r["lang_pred"] == langid.UNDETERMINED}
    assert und == {100, 101, 102, 105, 108, None}
    assert all(r["score"] == 0 for r in out if r["lang_pred"] == langid.UNDETERMINED)
    assert collect(langid.identify(no_docs, langid.fit(no_docs))) == []
    assert {r["lang_pred"] for r in collect(langid.identify(docs, langid.fit(no_docs)))} == {langid.UNDETERMINED}


def test_scores_are_the_kernel_expansion():
    import numpy as np
    import pyarrow as pa
    from trialspark.llm import text as T
    texts = ["abc abd", "le de la", "Das ist", "é"]
    sets = []
    for _, _, data, offsets in T.texts(pa.array(texts)):
        ids, ends = langid.presence(data, offsets)
        sets += [set(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
    for t, s in zip(texts, sets):
        f = langid._FOLD[np.frombuffer(t.encode(), np.uint8)].tolist()
        want = {c for n in (1, 2, 3) for c in {(n, *f[i:i + n]) for i in range(len(f) - n + 1)}}
        assert len(s) == len(want)


def test_pipeline_keeps_text_with_letters_without_a_model(spark, docs):
    import corpus_pipeline
    some = docs.select("doc_id", "text", "lang", "source")
    want = sorted(str(r.doc_id) for r in some.where(r"text rlike '\\p{L}'").collect())
    assert want
    for blind in (some.withColumn("lang", F.lit(None).cast("string")),
                  some.withColumn("lang", F.when(langid.held_out(), F.col("lang")))):
        assert sorted(str(r["doc_id"]) for r in collect(corpus_pipeline.language_id(spark, blind, ""))) == want


def test_model_matches_plain_kernel_ridge(spark):
    """Kernel matrix, Nystrom landmarks and one-against-rest ridge written out over sets of n-grams."""
    import numpy as np
    rng = random.Random(9)
    rows = [(i, prose(rng, lang, rng.randint(3, 30)), lang) for i in range(120) for lang in [rng.choice(list(WORDS))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in collect(langid.identify(df, langid.fit(df, per_language=25, landmarks=40)))}

    def grams(t):
        f = langid._FOLD[np.frombuffer(t.encode(), np.uint8)].tolist()
        return frozenset((n, *f[i:i + n]) for n in (1, 2, 3) for i in range(len(f) - n + 1))

    def kernel(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))
    learned = [(lang, i, grams(t)) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    sample = []
    for lang in WORDS:
        own = sorted((x for x in learned if x[0] == lang), key=lambda x: (order[x[1]], x[1]))
        sample += own[:25]
    # the library's own order of the sample: by language, then the bytes of the feature ids
    def ids(g):
        code = [langid.OFFSET[x[0] - 1] + sum(s * langid.SYMBOLS ** (x[0] - 1 - k) for k, s in enumerate(x[1:])) for x in g]
        return np.array(sorted(code), dtype=np.int64).tobytes()
    sample.sort(key=lambda x: (x[0], ids(x[2])))
    marks = np.sort(np.random.default_rng(7).permutation(len(sample))[:40])
    K = np.array([[kernel(x[2], sample[m][2]) for m in marks] for x in sample])
    langs = sorted(WORDS)
    Y = np.array([[1.0 if x[0] == lang else -1.0 for lang in langs] for x in sample])
    alpha = np.linalg.lstsq(K.T @ K + 1e-3 * len(sample) * K[marks], K.T @ Y, rcond=1e-10)[0]
    for i, t, _ in rows:
        s = np.array([kernel(grams(t), sample[m][2]) for m in marks]) @ alpha
        assert out[i]["lang_pred"] == langs[int(s.argmax())]
        assert abs(out[i]["score"] - min(max((s.max() + 1) / 2, 0), 1)) < 1e-3
