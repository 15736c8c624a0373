"""Registered queries over the test tables, each with an independent SQL formulation where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL that must give the same rows."""
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def load() -> None:
    """Import every section so that its queries are registered."""
    from catalog import (  # noqa: F401
        addresses,
        aggregates,
        emails,
        jobs,
        links,
        paging,
        results,
        streams,
        windows,
    )
