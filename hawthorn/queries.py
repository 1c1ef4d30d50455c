"""Queries of the rule engine and their SQL, collected from the plan modules."""

from __future__ import annotations

from .plans import assist, audit, dashboard, etl, extract, gaps, rules, store, validate  # noqa: F401
from .plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
