"""The queries of the text operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import (
    divergence_audit,
    hard_negatives,
    html_extraction,
    license_scan,
    neighbours,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    substring_dedup,
    toxicity,
    url_filters,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_packing": packing.op6_packing,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_divergence_audit": divergence_audit.op12_divergence_audit,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op8_url_filters": url_filters.ORACLE_SQL,
    "op12_divergence_audit": divergence_audit.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
