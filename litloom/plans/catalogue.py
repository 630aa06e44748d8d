"""All queries over the library's core operators, each with its SQL where SQL can express it.

A query is registered by its name; its SQL runs on views of the same tables in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _load() -> None:
    from litloom.plans import collection_queries, corpus_queries, identity_queries, retrieval_queries, statistics_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
