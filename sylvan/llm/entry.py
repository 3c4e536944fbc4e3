"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import op1_tokens, op2_quality, op3_toxicity, op4_neighbours, op5_leaks, op6_ids, op7_urls, op8_licenses, op9_jaccard, op10_mix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_tokens.query,
        "op2_quality_ranking": op2_quality.query,
        "op3_toxicity": op3_toxicity.query,
        "op4_nearest_neighbours": op4_neighbours.query,
        "op5_benchmark_leaks": op5_leaks.query,
        "op6_token_ids_orc": op6_ids.query,
        "op7_url_filter": op7_urls.query,
        "op8_license_scan": op8_licenses.query,
        "op9_jaccard_join": op9_jaccard.query,
        "op10_source_mix": op10_mix.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_url_filter": op7_urls.SQL,
        "op8_license_scan": op8_licenses.SQL,
        "op10_source_mix": op10_mix.SQL,
    }
