"""The whole cleaning of a raw word log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.nulls import sentinel_to_null
from trialspark.operators import cleaning, ordered
from trialspark.plans import log_oracle as oracle
from trialspark.plans.registry import register
from trialspark.session import stage_table
from trialspark.sources import roles

WORD, RECALL, START = "WORD", "REC_WORD", "REC_START"
LOG_ORDER = ["subject", "session", "mstime", "type", "trial", "serialpos"]
LIST_LENGTH, MIN_SUBJECTS = 4, 17
GAP_MIN_MS, GAP_MAX_MS = 2 * roles.DAY_MS, 1400 * roles.DAY_MS
FILL_BUCKET_MS = 30 * roles.DAY_MS
LAGGED = ["item", "serialpos", "recalled", "outpos", "category"]
EXCLUDED_SUBJECTS = [7, 77, 777]


def raw_log(spark, sf_dir) -> DataFrame:
    """Types, order, back-filled lists, tidy text and casts, before any check. The ordered log and the
    filled one are written tables, which the checks read instead of running the joins and the fill again."""
    log = cleaning.keep_types(roles.word_log(spark, sf_dir), [WORD, RECALL, START])
    log = ordered.row_order(log, LOG_ORDER)
    log = log.withColumn("list", F.when(F.col("type") == START, sentinel_to_null("list", [roles.NO_LIST])).otherwise(F.col("list")))
    log = ordered.backward_fill(log, ["subject", "session"], ["row_order"], "list", bucket=F.floor(F.col("mstime") / FILL_BUCKET_MS))
    log = cleaning.cast_columns(cleaning.normalise_text(log, fallback="item_name"), {"recalled": "bigint"})
    return stage_table(log, f"raw-log-{uuid.uuid4().hex}")


@register("clean_word_log", "P1,P2,P3,P5,P6,P10,W2,W7,W9,W11,W14,Q1,Q2,Q3,Q4,Q5,Q6,Q7,Q8,Q9,Q10,J1,J2,J3,J4,F9,F10,O1,O4", oracle.CLEAN_WORD_LOG)
def clean_word_log(spark, sf_dir):
    excluded = spark.createDataFrame([(s,) for s in EXCLUDED_SUBJECTS], "subject long")
    # the frozen population: sessions with an order that was not cancelled at once
    allowed = roles.read_table(spark, sf_dir, "orders").where("o_totalprice > 20000").select(
        F.col("o_custkey").alias("subject"), F.year("o_orderdate").cast("bigint").alias("session"))
    out = cleaning.clean_log(raw_log(spark, sf_dir), ["row_order"], WORD, RECALL, LIST_LENGTH, GAP_MIN_MS, GAP_MAX_MS,
                             excluded_subjects=excluded, allowed=allowed, min_subjects=MIN_SUBJECTS, lagged=LAGGED)
    return out.select("row_order", "subject", "session", "list", "type", "item", "category", "serialpos", "recalled", "outpos",
                      "recall_repeat", "first_recalled", *[f"prev_{c}" for c in LAGGED])
