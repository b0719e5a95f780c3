"""Registry of named queries over the driver tables and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` reading the given parquet
tables whole. ``sql`` (when given) is the same computation in ANSI SQL that
DuckDB runs on views of the same tables; column names match one to one.
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
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


QUERY_MODULES = (
    "queries_retrieval",
    "queries_metrics",
    "queries_text",
    "queries_chunking",
    "queries_vectors",
    "queries_context",
    "queries_qa",
    "queries_leaderboard",
    "queries_pages",
    "queries_keyphrases",
)


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for mod in QUERY_MODULES:
        importlib.import_module(f"{__package__}.{mod}")
