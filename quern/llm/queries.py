"""The queries opN_<name> and pipeline: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, kmeans_tree, license_scan, line_dedup, packing, quality_cnn, secret_scan, sentencepieces, simhash_dedup, va_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, _table(spark, sf_dir, "labels")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"), secret_scan.train())


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(_table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(_table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_probe(_table(spark, sf_dir, "conversations")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"), grams=True)


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_secret_scan": op3_secret_scan,
    "op4_license_scan": op4_license_scan,
    "op5_kmeans_tree": op5_kmeans_tree,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_va_file": op7_va_file,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_chat_format": op9_chat_format,
    "op10_line_dedup": op10_line_dedup,
}

#: SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {}
