"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function by its name, with DuckDB SQL over the driver's tables for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_tables(body: str, **tables: str) -> str:
    """SQL of body with the named common tables."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in tables.items()) + "\n" + body
