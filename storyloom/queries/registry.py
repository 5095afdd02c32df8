"""Name -> query and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ["intake", "coverage", "labeling", "matching", "grounding", "reports", "state", "runs"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        name = function.__name__
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"storyloom.queries.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
