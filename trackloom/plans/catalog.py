"""All queries of the track engine by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that gives the same rows if there is any."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


from trackloom.plans import byte_queries, file_queries, image_queries, scalar_queries, tool_queries, track_queries, transport_queries  # noqa: E402, F401
