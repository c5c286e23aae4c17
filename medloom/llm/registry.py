"""All queries of the subpackage, by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("neighbours_queries", "survivors_queries", "matching_queries", "canonical_queries", "leakage_queries", "mixing_queries", "spans_queries")


def _modules() -> list:
    return [importlib.import_module(f"medloom.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
