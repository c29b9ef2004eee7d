"""Operators for preparing training data; nothing else in the package imports this subpackage."""

from __future__ import annotations

import importlib

#: Query name: module of this subpackage with query() and, where SQL can express it, ORACLE.
MODULES = {
    "op1_boosted_dom_text": "html_text",
    "op10_pu_quality": "quality_model",
    "op6_ppm_language": "language_id",
    "op8_bbit_minhash": "near_dup",
    "op5_source_mixing": "mixing",
    "op7_line_frequency_rules": "quality_rules",
    "op3_pii_spans": "pii",
    "op9_bpe_encode_decode": "bpe",
    "op2_warc_archives": "warc",
    "op4_exact_topk": "topk",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__name__}.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__name__}.{m}"), "ORACLE", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
