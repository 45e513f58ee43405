"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
ENTRY = "heat_events"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, the statement that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def load() -> None:
    """Imports the modules that register queries."""
    from . import detail_queries, gate_queries, geo_queries, match_queries, overlay_queries, publish_queries, series_queries, source_queries, vector_queries  # noqa: F401
