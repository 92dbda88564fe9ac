"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module that holds a function of that name
_QUERIES = {
    "op1_byte_bpe": "bpe",
    "op2_pii": "pii",
    "op3_toxicity": "toxicity",
    "op4_html_text": "pages",
    "op5_line_dedup": "lines",
    "op6_minhash": "minhash",
    "op7_quality_rules": "quality",
    "op8_best_fit_packing": "packing",
    "op9_media_columns": "media",
    "op10_suffix_array": "suffixes",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _QUERIES.items():
        sql = getattr(import_module(f".{module}", __package__), "ORACLE_SQL", {})
        found.update({k: v for k, v in sql.items() if k == name})
    return found
