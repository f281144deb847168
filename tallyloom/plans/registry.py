"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


from tallyloom.plans import governance, lifecycle, retrieval, structure, summaries  # noqa: E402,F401
