"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import op1_exact_dedup, op2_quality, op3_sketch, op4_language, op5_bpe, op6_jaccard, op7_url_filter, op8_store, op9_packing, op10_licenses

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup.query,
        "op2_quality": op2_quality.query,
        "op3_sketch": op3_sketch.query,
        "op4_language": op4_language.query,
        "op5_bpe": op5_bpe.query,
        "op6_jaccard": op6_jaccard.query,
        "op7_url_filter": op7_url_filter.query,
        "op8_store": op8_store.query,
        "op9_packing": op9_packing.query,
        "op10_licenses": op10_licenses.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": op1_exact_dedup.SQL,
        "op6_jaccard": op6_jaccard.SQL,
        "op7_url_filter": op7_url_filter.SQL,
        "op10_licenses": op10_licenses.sql(),
    }
