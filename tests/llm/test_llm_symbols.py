"""The quality model keeps every symbol apart (finding of round 3)."""

import numpy as np
from corpus_fixture import collect

from trialspark.llm import kneserney


def test_texts_that_differ_in_capitals_digits_or_letters_beyond_ascii_are_scored_apart(spark):
    texts = ["the book is HERE", "the book is PERE", "at 1999", "at 1234", "слово за словом", "слоуо за слооом"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(i, texts[i % 3 * 2], "x") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["perplexity"] for r in collect(kneserney.classify(df, spark.createDataFrame([(i, 1) for i in range(10, 40)], "doc_id long, quality int")))}
    assert len(out) == 36 and out[0] != out[1] and out[2] != out[3] and out[4] != out[5]
    codes = {kneserney._trigrams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), kneserney.BYTES)[0].tobytes() for t in texts}
    assert len(codes) == 6
