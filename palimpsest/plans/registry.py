"""Queries and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame, and the DuckDB SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _module in ("catalogue", "history", "webpages", "searching", "indexing", "incremental", "auditing", "upkeep", "administration", "formats", "archives", "listings"):
    importlib.import_module(f"palimpsest.plans.{_module}")
