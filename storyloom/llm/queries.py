"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import bpe, fingerprint, line_dedup, lm, near_dedup, packing, pii, quality_rules, secrets, substring_dedup

_MODULES = {
    "op1_near_dedup": near_dedup,
    "op2_quality_rules": quality_rules,
    "op3_pii": pii,
    "op4_packing": packing,
    "op5_line_dedup": line_dedup,
    "op6_lm": lm,
    "op7_substring_dedup": substring_dedup,
    "op8_secrets": secrets,
    "op9_fingerprint": fingerprint,
    "op10_bpe": bpe,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
