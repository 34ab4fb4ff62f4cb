"""All registered queries over the relational model, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with SQL that gives the same rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql
        return fn

    return add


from quarry.plans import queries_extract, queries_graph, queries_search, queries_sources, queries_store  # noqa: E402, F401
