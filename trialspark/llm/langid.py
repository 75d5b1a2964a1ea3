"""Language identification by string-kernel classification.

Kernel: blended spectrum of n-gram presence (n = 1..3) over a folded alphabet of 64 symbols
(a-z without case, one symbol for everything else in ASCII, the other bytes of UTF-8 dealt over
the rest), k(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|). A ridge regression for each language
against the rest is solved on Nystrom landmarks; landmark presence times landmark weights collapse
into one weight row per n-gram, so a batch of documents is scored by one product of its presence
rows with that matrix.

The model is fitted on a bounded sample of labelled rows: at most ``per_language`` documents of each
language (least hash of doc_id), whole texts, of which ``landmarks`` in all are landmarks. It has at
most 64 + 64^2 + 64^3 weight rows, which bounds what is sent to the tasks.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is every text when
there is no labelled row. An empty table gives an empty result. A null doc_id counts as the empty
text in the crc32 split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm import text as T
from trialspark.llm.staging import arrow_map, ship, stage

UNDETERMINED = "und"
SYMBOLS, MAX_N = 64, 3
OFFSET = (0, SYMBOLS, SYMBOLS + SYMBOLS ** 2)
FEATURES = sum(SYMBOLS ** n for n in range(1, MAX_N + 1))
_FOLD = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0 if b < 128 else 27 + b % 37
                  for b in range(256)], dtype=np.int32)


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of each text of a chunk, flat, with offsets."""
    s = _FOLD[data]
    grams = [s]
    for n in range(2, MAX_N + 1):
        grams.append(grams[-1][:-1] * SYMBOLS + s[n - 1:] if len(grams[-1]) else grams[-1])
    seen = np.zeros(FEATURES, dtype=bool)
    found, ends = [], [0]
    for a, b in zip(offsets[:-1], offsets[1:]):
        for n in range(1, min(MAX_N, b - a) + 1):
            seen[grams[n - 1][a:b - n + 1] + OFFSET[n - 1]] = True
        ids = np.flatnonzero(seen)
        seen[ids] = False
        found.append(ids)
        ends.append(ends[-1] + len(ids))
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.array(ends)


def _features(batches):
    for batch in batches:
        lang = batch.column(0)
        for a, b, data, offsets in T.texts(batch.column(1)):
            ids, ends = presence(data, offsets)
            yield pa.RecordBatch.from_arrays([lang.slice(a, b - a), T.lists(ids, ends)], names=["lang", "ids"])


def held_out(column="doc_id", folds: int = 3, fold: int = 1):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds == fold


def fit(docs: DataFrame, per_language: int = 300, landmarks: int = 400, ridge: float = 1e-3) -> dict:
    """Weights from the labelled rows of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                                                       & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = stage(rows.select("doc_id", "lang").withColumn("r", F.row_number().over(order))
                   .where(F.col("r") <= per_language).drop("r").where("doc_id is not null").distinct(), "sample")
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select("lang", "text")
    got = arrow_map(sample, _features, "lang string, ids array<long>").collect()
    # the same sample in the same order on every run
    got = sorted(((r.lang, np.array(r.ids, dtype=np.int64)) for r in got if r.ids), key=lambda x: (x[0], x[1].tobytes()))
    langs = sorted({lang for lang, _ in got})
    empty = {"langs": [], "row": np.zeros(FEATURES, np.int32), "weights": np.zeros((1, 0), np.float32)}
    if not got:
        return empty
    n = len(got)
    rng = np.random.default_rng(7)
    marks = np.sort(rng.permutation(n)[:landmarks])
    vocabulary = np.unique(np.concatenate([got[i][1] for i in marks]))
    row = np.zeros(FEATURES, dtype=np.int32)  # 0: a feature that no landmark has
    row[vocabulary] = np.arange(1, len(vocabulary) + 1)
    P = np.zeros((len(marks), len(vocabulary) + 1), dtype=np.float32)
    for k, i in enumerate(marks):
        P[k, row[got[i][1]]] = 1 / np.sqrt(len(got[i][1]))
    P[:, 0] = 0
    K = np.stack([P[:, row[ids]].sum(axis=1) / np.sqrt(len(ids)) for _, ids in got]).astype(np.float64)
    Y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in got])
    alpha = np.linalg.lstsq(K.T @ K + ridge * n * K[marks], K.T @ Y, rcond=1e-10)[0]
    return {"langs": langs, "row": row, "weights": (P.T.astype(np.float64) @ alpha).astype(np.float32)}


def _score_batches(model, text_at: int, letter_at: int):
    def run(batches):
        m = model.value
        langs, row, W = np.array([*m["langs"], UNDETERMINED], dtype=object), m["row"], m["weights"]
        for batch in batches:
            pred = np.full(batch.num_rows, len(langs) - 1)
            score = np.zeros(batch.num_rows)
            if len(langs) > 1 and batch.num_rows:
                letters = batch.column(letter_at).to_numpy(zero_copy_only=False).astype(bool)
                for a, b, data, offsets in T.texts(batch.column(text_at)):
                    ids, ends = presence(data, offsets)
                    total = np.vstack([np.zeros((1, W.shape[1])), np.cumsum(W[row[ids]], axis=0, dtype=np.float64)])
                    s = (total[ends[1:]] - total[ends[:-1]]) / np.sqrt(np.maximum(np.diff(ends), 1))[:, None]
                    ok = letters[a:b]
                    pred[a:b][ok] = s.argmax(axis=1)[ok]
                    score[a:b][ok] = np.clip((s.max(axis=1)[ok] + 1) / 2, 0, 1)
            keep = [c for i, c in enumerate(batch.columns) if i != letter_at]
            names = [x for i, x in enumerate(batch.schema.names) if i != letter_at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(langs[pred], pa.string()), pa.array(score)],
                                             names=[*names, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); columns of these names are replaced. One pass."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = docs.withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    weights = spark.sparkContext.broadcast(model)
    return arrow_map(marked, _score_batches(weights, docs.columns.index("text"), len(docs.columns)),
                     f"{fields}, lang_pred string, score double")
