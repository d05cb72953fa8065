"""All registered queries over the driver's tables and their SQL."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that DuckDB runs for it."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return add


def _load() -> None:
    import importlib

    for name in ("frame_queries", "text_queries", "vector_queries", "retrieval_queries", "graph_queries", "state_queries", "catalog_queries", "source_queries", "stream_queries", "word_queries", "design_queries"):
        if importlib.util.find_spec(f"mnemospark.plans.{name}") is not None:
            importlib.import_module(f"mnemospark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
