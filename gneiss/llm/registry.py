"""Queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import decontamination, html_extraction, language_id, near_dedup, packing, quality_classifier, quality_rules, quote_linking, substring_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_near_dedup": near_dedup.query,
        "op3_html_extraction": html_extraction.query,
        "op4_quality_rules": quality_rules.query,
        "op5_quality_classifier": quality_classifier.query,
        "op6_decontamination": decontamination.query,
        "op7_quote_linking": quote_linking.query,
        "op8_warc": warc.query,
        "op9_language_id": language_id.query,
        "op10_packing": packing.query,
        "quality_rule_verdicts": quality_rules.verdicts_query,
        "quoted_conversations": quote_linking.quoting_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": decontamination.ORACLE,
        "op8_warc": warc.ORACLE,
        "quality_rule_verdicts": quality_rules.VERDICTS_ORACLE,
    }
