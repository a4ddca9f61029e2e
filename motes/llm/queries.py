"""The registered queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name → module with query(spark, sf_dir) and perhaps ORACLE.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_mixing": "mixing",
    "op3_substring_dedup": "substring_dedup",
    "op4_quality": "quality",
    "op5_minhash": "near_dedup",
    "op6_secrets": "secrets",
    "op7_pii": "pii",
    "op8_decontamination": "decontaminate",
    "op9_simhash": "simhash",
    "op10_toxicity": "toxicity",
    "op11_hard_negatives": "hard_negatives",
    "op12_centroids": "centroids",
    "op13_token_counts": "token_counts",
}


def queries() -> dict:
    found = {name: importlib.import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    modules = {name: importlib.import_module(f"{__package__}.{module}") for name, module in MODULES.items()}
    return {name: m.ORACLE for name, m in modules.items() if hasattr(m, "ORACLE")}
