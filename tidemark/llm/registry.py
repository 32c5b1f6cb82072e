"""Queries of the operators in this folder, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import conversation_repair, decontaminate, exact_dedup, importance, license_scan, mixing, ngram_join, quality, secret_scan, suffix_dedup, toxicity, url_rules, warc


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_quality": quality.op5_quality,
        "op6_warc": warc.op6_warc,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_mixing": mixing.op9_mixing,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_importance": importance.op11_importance,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_url_filters": url_rules.op13_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": warc.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op10_license_scan": license_scan.ORACLE, "op1_secret_scan": secret_scan.ORACLE, "op11_importance": importance.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE, "op13_url_filters": url_rules.ORACLE}
