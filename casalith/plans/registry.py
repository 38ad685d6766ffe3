"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

PARTS = ("search_plans", "entity_plans", "scalar_plans", "result_plans", "vector_plans", "lineage_plans", "read_plans", "record_plans")


def _all(name: str) -> dict:
    found: dict = {}
    for p in PARTS:
        found |= getattr(import_module(f"{__package__}.{p}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
