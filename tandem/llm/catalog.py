"""The driver queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_simhash": "simhash",
    "op2_toxicity": "toxicity",
    "op3_secrets": "secrets",
    "op4_mixing": "mixing",
    "op5_ann": "ann",
    "op6_packing": "packing",
    "op7_pii": "pii",
    "op8_matroska": "matroska",
    "op9_chat": "chat",
    "op10_line_dedup": "linededup",
}


def queries() -> dict:
    return {name: getattr(import_module(f"tandem.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tandem.llm.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
