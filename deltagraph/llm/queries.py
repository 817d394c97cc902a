"""Queries of this subpackage: name -> function of (spark, sf_dir), and the SQL where there is one."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_quality": "quality",
    "op3_embedding_dedup": "embedding_dedup",
    "op4_warc": "warc",
    "op5_mixing": "mixing",
    "op6_language_id": "language_id",
    "op7_decontamination": "decontamination",
    "op8_ngram_join": "ngram_join",
    "op9_license_scan": "license_scan",
    "op10_url_filter": "url_filter",
}


def _load(name: str):
    return importlib.import_module(f"deltagraph.llm.{_MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_load(name), name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in _MODULES if (sql := getattr(_load(name), "ORACLE", None))}
