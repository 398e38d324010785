"""The text operators as named queries over the driver tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


from . import queries_clean, queries_format, queries_match, queries_model  # noqa: E402, F401
