"""All registered queries of the traffic engine, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("counters", "projections", "scalars", "joins", "series", "sketches", "rules", "quic", "runs", "logs", "ranking", "streams", "models", "documented", "files")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under a name, with its SQL."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tidegate.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
