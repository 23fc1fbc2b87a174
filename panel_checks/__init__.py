"""Queries over the driver's tables, each next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("panels", "features", "tables", "scoring", "statistics", "models", "studies", "streams")


def _in_utc(spark: SparkSession) -> SparkSession:
    """Timestamps without a zone are compared with SQL that has none."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the DuckDB SQL that computes the same rows if there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = wraps(fn)(lambda spark, sf: fn(_in_utc(spark), sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
