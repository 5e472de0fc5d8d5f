"""Registered queries of the operators here, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendspark.llm.centroids import cluster_vectors
from spendspark.llm.chat import chat_digests, format_branches, linear_messages
from spendspark.llm.decontaminate import find_contaminated
from spendspark.llm.language import detect_languages, learn_languages
from spendspark.llm.length_packing import pack_by_length
from spendspark.llm.line_dedup import drop_repeated_lines
from spendspark.llm.near_duplicates import near_duplicate_classes
from spendspark.llm.oracle import OP2_SQL, OP5_SQL, OP6_SQL, OP9_SQL, OP11_SQL
from spendspark.llm.packing import pack_documents
from spendspark.llm.pii import pseudonymise
from spendspark.llm.quality import score_quality
from spendspark.llm.sharding import assign_shards
from spendspark.llm.urls import judge_urls, listed_by_label
from spendspark.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return assign_shards(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(_table(spark, sf_dir, "documents"),
                             _table(spark, sf_dir, "benchmark")).drop("th")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", "text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return detect_languages(docs, learn_languages(docs)).drop("runs")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents")).drop("n_covered", "longest_repeat")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, listed_by_label(pages))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), "registered query")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{says}'), "
                      f"(-1L, 1L, 'assistant', '{says}') AS t(conv_id, turn, role, text)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_branches(linear_messages(turns.unionByName(probe))))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("dots")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_length(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filters": op6_url_filters,
    "op7_minhash": op7_minhash,
    "op8_pii": op8_pii,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_packing": op10_packing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_best_fit_packing": op13_best_fit_packing,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op6_url_filters": OP6_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op11_centroid_clustering": OP11_SQL,
}
