"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from importlib import import_module

#: Module and query of each operator.
_QUERIES = {
    "token_files": ("op3_token_files",),
    "license_scan": ("op5_license_scan",),
    "mixing": ("op7_mixing",),
    "html_text": ("op9_html_text",),
    "ngram_join": ("op6_ngram_join",),
    "decontaminate": ("op10_decontaminate",),
    "quality": ("op1_quality",),
    "language_id": ("op8_language_id",),
    "media_audio": ("op4_media_audio",),
    "chat_format": ("op2_chat_format",),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, names in _QUERIES.items() for name in names}


def oracle_sql() -> dict[str, str]:
    found = (getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}) for module in _QUERIES)
    return {name: sql for part in found for name, sql in part.items()}
