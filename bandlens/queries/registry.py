"""Where queries register, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, function: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = function
    if sql:
        SQL[name] = sql


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name."""

    def register(f: Callable) -> Callable:
        add(f.__name__, f, sql)
        return f

    return register


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero, as the SQL side does it."""
    return F.round(c, digits) + F.lit(0.0)
