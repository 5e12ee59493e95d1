"""Wide to long without extra passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per (row, metric); values as double."""
    values = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select(*ids, *values).unpivot(ids, metrics, name, value)


def fan_out(df: DataFrame, keys: list[str], items: list, fields: Callable[[object], dict[str, Column]]) -> DataFrame:
    """Turn each row of a small wide result into one row per item, in one projection."""
    structs = [F.struct(*[column.alias(n) for n, column in fields(item).items()]) for item in items]
    return df.select(*keys, F.inline(F.array(*structs)))
