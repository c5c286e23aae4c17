"""All queries of the core library, by name, with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("relational", "extended", "nested", "units")


def _modules() -> list:
    return [importlib.import_module(f"medloom.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
