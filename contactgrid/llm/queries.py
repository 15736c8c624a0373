"""Registry of the queries of this subpackage; each operator module adds its own."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("token_counts", "token_files", "packing", "quality", "simhash", "line_templates", "warc",
           "mixing", "suffixes", "neighbours", "alignment", "conversations", "jaccard")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with SQL that must give the same rows if there is any."""
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def load() -> None:
    """Import every operator module, so that its queries are registered."""
    for module in MODULES:
        importlib.import_module(f"contactgrid.llm.{module}")
