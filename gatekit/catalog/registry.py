"""Registry of named queries: a Spark function over (spark, sf_dir) and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in SPARK:
            raise ValueError(f"query {name} is registered twice")
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
