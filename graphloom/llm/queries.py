"""Registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_suffix_dedup,
    op2_decontaminate,
    op3_chunks,
    op4_repair,
    op5_minhash,
    op6_toxicity,
    op7_warc,
    op8_licenses,
    op9_token_counts,
    op10_pack,
    op11_hard_negatives,
    op12_best_fit,
    op13_repair_turns,
)

_MODULES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_chunks": op3_chunks,
    "op4_repair": op4_repair,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_licenses": op8_licenses,
    "op9_token_counts": op9_token_counts,
    "op10_pack": op10_pack,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit": op12_best_fit,
    "op13_repair_turns": op13_repair_turns,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if module.SQL}
