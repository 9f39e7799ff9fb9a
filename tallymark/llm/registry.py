"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: query name -> module of this subpackage with query() and perhaps ORACLE_SQL
MODULES = {
    "op1_exact_dedup": "exact_dedup",
    "op2_quality_classifier": "quality_classifier",
    "op3_mixing": "mixing",
    "op4_url_filters": "url_filters",
    "op5_bpe": "bpe",
    "op6_lm_scoring": "lm_scoring",
    "op7_near_dedup": "near_dedup",
    "op8_html_text": "html_text",
    "op9_language_id": "language_id",
    "op10_quality_rules": "quality_rules",
    "op11_collocations": "collocations",
    "op12_filter_audit": "filter_audit",
    "op13_simhash": "simhash",
}


def queries() -> dict[str, Callable]:
    return {name: import_module(f".{module}", __package__).query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
