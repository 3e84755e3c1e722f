"""The corpus pipeline: quality, line dedup, near-duplicates, secrets, packing; each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import line_dedup, packing, quality_cnn, secret_scan, simhash_dedup
from quern.llm.common import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.5 or more; it learns from the labels that are not held out."""
    return quality_cnn.keep_good(docs, quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat elsewhere."""
    return line_dedup.dedup_lines(docs, grams=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs, secret_scan.train())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("best_fit_packing", pack),
]

#: No stage of the five can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
