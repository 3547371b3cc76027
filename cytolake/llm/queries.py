"""Queries on the driver's tables, one per operator, and the SQL they can be checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytolake.llm import content_sort, conversation_repair, cover_tree, decontaminate, hmm, main_text, ordinal, pieces, quality, secrets, simhash, token_store, url_filter
from cytolake.llm.oracles import ORACLES  # noqa: F401
from cytolake.runtime import stage_path


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: host, path, verdict
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_table(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("why", ",").alias("why"))


def op5_simhash_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_secret_scans(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secret_table(table(spark, d, "documents"))


def op6_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(table(spark, d, "documents").select("doc_id", "text"), PIECES).drop("text")


def op1_token_ids(spark: SparkSession, d: str) -> DataFrame:
    path = stage_path(spark, "token-ids")
    token_store.write(table(spark, d, "documents"), path, BYTE_BPE, end=0)
    return token_store.digest(spark, path)


def op9_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Grades 0 to 2: a point for quality, a point for not being toxic."""
    docs = table(spark, d, "documents")
    model = ordinal.train(docs, table(spark, d, "labels"), F.col("quality") + 1 - F.col("toxic"), 3)
    return ordinal.score(docs, model)


def op10_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return main_text.extract(table(spark, d, "pages"))


def op8_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judge(table(spark, d, "pages"), URL_RULES)


def op7_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return hmm.score_table(table(spark, d, "documents"))


def op11_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return cover_tree.code_table(table(spark, d, "embeddings"))


def op12_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return conversation_repair.repair_table(table(spark, d, "conversations"))


def op13_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return content_sort.duplicates(table(spark, d, "documents"))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_secret_scans": op2_secret_scans,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_near_duplicates": op5_simhash_near_duplicates,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_url_filters": op8_url_filters,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_extraction": op10_html_extraction,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_exact_dedup": op13_exact_dedup,
}
