"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkdlp.llm import (
    bpe,
    chat_format,
    cotraining,
    decontaminate,
    lang_id,
    line_dedup,
    merkle,
    order_minhash,
    pii,
    quality_rules,
    reversed_search,
    sharding,
    token_counts,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, *quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "n_words")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), finish="digest").drop("body")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, _table(spark, sf_dir, "labels")))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.recount(docs, token_counts.cleaning_edits(docs)).drop("body")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).drop("body", "found")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = chat_format.HOSTILE
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.formatted(rows.unionByName(extra)))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_bpe": op4_bpe,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_order_minhash": op6_order_minhash,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
    "op11_chat_format": op11_chat_format,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_reversed_search": op13_reversed_search,
}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL.format(min_sites=line_dedup.MIN_SITES),
    "op11_chat_format": chat_format.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_reversed_search": reversed_search.SQL,
}
