"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphsieve.llm import arc, bpe, decontaminate, line_dedup, minhash_dedup, pii, quality_rules, secrets, token_counts, url_rules

OPERATORS = {
    "op1_decontaminate": decontaminate,
    "op2_secret_scan": secrets,
    "op3_bpe": bpe,
    "op4_line_dedup": line_dedup,
    "op5_arc_to_warc": arc,
    "op6_minhash_dedup": minhash_dedup,
    "op7_quality_rules": quality_rules,
    "op8_url_rules": url_rules,
    "op9_sanitise": pii,
    "op10_token_counts": token_counts,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.oracle() for name, module in OPERATORS.items() if hasattr(module, "oracle")}
