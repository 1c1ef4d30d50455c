"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, exact_topk, license_scan, minhash_dedup, mixing, quality_classifier, quality_rules, suffix_dedup, url_filters

MODULES = [url_filters, chat_format, bpe, suffix_dedup, minhash_dedup, quality_rules, exact_topk, mixing, quality_classifier, license_scan]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
