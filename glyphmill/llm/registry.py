"""Queries of this subpackage over the driver's tables, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontaminate, line_dedup, near_dedup, packing, pii, quality_rules, rule_ensemble, sharding, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_quality_rules": quality_rules.query,
        "op3_url_filters": url_filter.query,
        "op4_best_fit_packing": packing.query,
        "op5_decontamination": decontaminate.query,
        "op6_near_dedup": near_dedup.query,
        "op7_pii": pii.query,
        "op8_quality_classifier": rule_ensemble.query,
        "op9_sharding": sharding.query,
        "op10_line_dedup": line_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against brute force and held-out labels."""
    return {
        "op3_url_filters": url_filter.SQL,
        "op5_decontamination": decontaminate.SQL,
        "op6_near_dedup": near_dedup.SQL,
        "op9_sharding": sharding.SQL,
        "op10_line_dedup": line_dedup.SQL,
    }
