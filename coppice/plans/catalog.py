"""The registered queries of the library's own operators and their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "clone_doc_exact"

#: Modules with QUERIES and ORACLES.
MODULES = ("algebra", "clones", "vocabulary", "mining", "graphs", "rules")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"coppice.plans.{module}"), name)
    return found


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
