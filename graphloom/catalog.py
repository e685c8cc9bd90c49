"""Registry of the engine's queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``, with its SQL where SQL can say it."""

    def put(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    """Registers what the query modules define."""
    from graphloom.operators import chunked, citations, extraction, graph, relational, resolution, retrieval, stats, texts, vector_index, windows  # noqa: F401
    from graphloom.sources import exchange, queries as _sources, triples  # noqa: F401
    from graphloom.streaming import queries as _streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["node_stats_batch"](spark, sf_dir)
