"""Registered queries over the given tables, and the SQL each of them must agree with."""

from __future__ import annotations

from importlib import import_module

AREAS = ("matching", "texts", "knowledge")


def all_queries() -> dict:
    found: dict = {}
    for area in AREAS:
        found.update(import_module(f"{__name__}.{area}").QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for area in AREAS:
        found.update(import_module(f"{__name__}.{area}_sql").SQL)
    return found
