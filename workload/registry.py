"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatally.functions.numbers import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def shown(df: DataFrame, digits: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded and dates as text, so that both engines print the same value."""
    changes = {}
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType) and f.name not in keep:
            changes[f.name] = settled(F.col(f.name), digits)
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            changes[f.name] = F.col(f.name).cast("string")
    return df.withColumns(changes)


def he(expr: str, digits: int) -> str:
    """SQL twin of half_even."""
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def st(expr: str, digits: int) -> str:
    """SQL twin of settled."""
    return he(he(expr, digits + 3), digits)


def with_sql(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"


def union_sql(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)
