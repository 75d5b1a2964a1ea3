"""The named queries of this subpackage over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import caps, decontaminate, hmm, kneserney, langid, licenses, lines, merkle, minhash, mixing, oracle, secrets, topk, whitening
from trialspark.llm.staging import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near_items")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    base = secrets.KINDS[:3]
    return found.select("doc_id", *[secrets.count_kind("spans", k).alias(f"n_{k}") for k in base],
                        F.sha2(secrets.digest("spans", base), 256).alias("base_sha256"),
                        secrets.digest("spans").alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.regexp_replace("text", "\n", ""))
    rows, _, _ = merkle.manifest(table(spark, sf_dir, "documents"), changed=tampered)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                       "folded_root", "verified")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_source_mix": op5_source_mix,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_exact_topk": op13_exact_topk,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": oracle.OP1,
    "op3_minhash_near_dedup": oracle.OP3,
    "op5_source_mix": oracle.OP5,
    "op6_benchmark_decontamination": oracle.OP6,
    "op9_line_dedup": oracle.OP9,
    "op11_merkle_manifest": oracle.OP11,
    "op13_exact_topk": oracle.OP13,
}
