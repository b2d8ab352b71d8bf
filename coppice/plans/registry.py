"""Collects the queries of a module."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    """Empty queries and oracles, and the decorator that fills them."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
