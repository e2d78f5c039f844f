"""Registry of named queries (Spark) and their DuckDB oracle statements.

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame;
the oracle, when there is one, is a DuckDB statement over the raw tables
that must give the same rows (column names included).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from engram.plans import (  # noqa: F401
        account_queries, billing_queries, graph_queries, ingest_queries, memory_queries, mutate_queries, parts_queries, source_queries,
        store_queries, team_queries, tool_queries, usage_queries)
    from engram.plans import stream_queries  # noqa: F401  (uses the oracles above)
