"""Queries of the terrain engine by name, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as the query `name`, and its SQL."""

    def keep(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["slope"](spark, sf_dir)
