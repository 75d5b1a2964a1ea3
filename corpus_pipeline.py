"""The corpus pipeline: stages applied in order to ``documents``.

Every stage but the last returns the columns of its input. What they do with hard cases: a null
``text`` has no language and goes in the first stage; lines and copies are judged by doc_id, and rows
without one are kept as they are unless a later stage names another reason; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import decontaminate, langid, lines, minhash, mixing
from trialspark.llm.staging import small_or_plain, stage, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null text, or text without a letter. Where no row is
    labelled outside the held-out fold there is no model to ask, and the letters alone decide."""
    model = langid.fit(docs)
    if not model["langs"]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.identify(docs, model)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, equal ones of any length that hold a word; a document that loses all its
    text to earlier ones goes."""
    found = lines.dedup_lines(docs, short=True)
    emptied = (F.col("n_dropped") > 0) & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) == 0)
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near copies (five-word shingles, similarity 0.8), and one
    of several rows with one doc_id."""
    classes = stage(minhash.near_duplicates(docs, k=5, percent=80), "classes")
    others = stage(classes.where("not kept").select("doc_id").distinct(), "others")
    left = docs.join(small_or_plain(others, 16), "doc_id", "left_anti")
    repeated = stage(classes.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
                     .select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    single = left.join(small_or_plain(repeated, 16), "doc_id", "left_anti")
    return single.unionByName(left.join(small_or_plain(repeated, 16), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    leaks = stage(found.where("contaminated and doc_id is not null").select("doc_id").distinct(), "leaks")
    return docs.join(small_or_plain(leaks, 16), "doc_id", "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each drawn block, with its words taken, output shard and shuffle key."""
    columns = docs.columns
    return mixing.blocks(mixing.mix(docs), columns)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mix", source_mix),
]

#: the language model of the first stage is outside SQL; tests hold run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
