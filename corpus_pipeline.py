"""A training corpus from the documents table: good texts, in a known language, one of each group of copies, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import op1_exact_dedup, op2_quality, op4_language, op6_jaccard, op9_packing
from gridloom.llm.common import shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    return op2_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language."""
    return op4_language.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return op1_exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.75 or more, that with the smallest doc_id."""
    return op6_jaccard.keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece of a document."""
    return op9_packing.best_fit_pack(docs)


STAGES = [("quality", quality), ("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: The classifiers can't be expressed in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
