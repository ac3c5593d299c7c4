"""The registered queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _queries:
        raise ValueError(f"{name} is registered twice")
    _queries[name] = query
    if sql:
        _sql[name] = sql


def queries() -> dict[str, Query]:
    from . import catalog, chunks, corpus, files, quality, roundtrip, scores, significance, statistics, structure, training  # noqa: F401  (register on import)

    return _queries


def oracle_sql() -> dict[str, str]:
    queries()
    return _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["SCA11"](spark, sf_dir)
