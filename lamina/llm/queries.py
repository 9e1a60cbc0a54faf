"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from lamina.llm import bpe, graph_search, license_scan, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, suffix_dedup, token_counts
from lamina.llm.sql import license_sql, line_dedup_sql, mixing_sql, quality_sql


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_graph_search": graph_search.op4_graph_search,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_bpe": bpe.op7_bpe,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_sql(), "op3_mixing": mixing_sql(), "op8_license_scan": license_sql(), "op9_line_dedup": line_dedup_sql()}
