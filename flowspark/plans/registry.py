"""Registry of runnable queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round result columns so that both engines print the same digits."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in columns})


def r(expression: str, name: str) -> str:
    """SQL counterpart of :func:`rounded`."""
    return f'round(CAST({expression} AS DOUBLE), {DIGITS}) AS "{name}"'


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column))
