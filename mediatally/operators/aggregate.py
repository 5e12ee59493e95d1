"""Aggregates: daily, weekly, per dimension, table totals, overall ratios, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatally.functions.numbers import ratio, ratio_or_zero, settled, total
from mediatally.operators.reshape import fan_out
from mediatally.operators.roles import (
    dimension_columns, metric_columns, text_columns, time_axis, time_columns,
)


def _sum_mean(metrics: list[str]) -> list[Column]:
    parts = []
    for m in metrics:
        parts += [total(F.col(m)).alias(f"{m}_sum"), F.avg(F.col(m).cast("double")).alias(f"{m}_mean")]
    return parts


def daily(df: DataFrame, metrics: list[str] | None = None, time: str | None = None) -> DataFrame:
    """(date, <metric>_sum, <metric>_mean ...) per calendar day; rows without a time are left out."""
    metrics, time = metrics or metric_columns(df), time or time_axis(df)
    day = F.to_date(F.col(time))
    rows = df.select(day.alias("__day"), *metrics).where(F.col("__day").isNotNull())
    return rows.groupBy("__day").agg(*_sum_mean(metrics)).withColumnRenamed("__day", "date")


def weekly(df: DataFrame, metrics: list[str] | None = None, time: str | None = None, iso_year: bool = False) -> DataFrame:
    """(year, week, sums and means) by calendar year and ISO week number.

    30 December 2024 falls in (2024, 1); ``iso_year=True`` uses the ISO year (2025, 1) instead.
    """
    metrics, time = metrics or metric_columns(df), time or time_axis(df)
    at = F.col(time)
    year = F.extract(F.lit("YEAROFWEEK"), at) if iso_year else F.year(at)
    rows = df.where(at.isNotNull()).select(year.alias("__year"), F.weekofyear(at).alias("__week"), *metrics)
    return (
        rows.groupBy("__year", "__week").agg(*_sum_mean(metrics))
        .withColumnsRenamed({"__year": "year", "__week": "week"})
    )


def by_dimension(df: DataFrame, dimensions: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """(dimension, name, <metric>_sum, _mean, _count ...) for every dimension in one pass.

    The dimensions are unpivoted before one grouped aggregate, so the table is read and shuffled once
    and partial aggregation leaves one row per (task, dimension, name) for the shuffle.
    """
    dimensions, metrics = dimensions or dimension_columns(df), metrics or metric_columns(df)
    long = df.select(*dimensions, *[m for m in metrics if m not in dimensions]).unpivot(
        metrics, dimensions, "dimension", "name"
    ).where(F.col("name").isNotNull())
    parts = []
    for m in metrics:
        value = F.col(m).cast("double")
        parts += [total(F.col(m)).alias(f"{m}_sum"), F.avg(value).alias(f"{m}_mean"), F.count(m).alias(f"{m}_count")]
    return long.groupBy("dimension", "name").agg(*parts)


def dimension_totals(df: DataFrame, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """(dimension, metric, name, value): sums only, one pass over all dimensions and metrics."""
    long = df.select(*dimensions, *metrics).unpivot(metrics, dimensions, "dimension", "name")
    wide = (
        long.where(F.col("name").isNotNull())
        .groupBy("dimension", "name").agg(*[total(F.col(m)).alias(m) for m in metrics])
    )
    return wide.unpivot(["dimension", "name"], metrics, "metric", "value").select("dimension", "metric", "name", "value")


def distinct_counts(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, names): exact distinct non-null values per column, two map-side-combined aggregates."""
    return (
        df.select(*dimensions).unpivot([], dimensions, "dimension", "name")
        .where(F.col("name").isNotNull())
        .groupBy("dimension", "name").agg(F.lit(1).alias("one"))
        .groupBy("dimension").agg(F.count(F.lit(1)).alias("names"))
    )


def value_counts(df: DataFrame, column: str, n: int | None = 8) -> DataFrame:
    """(name, rows): most frequent values, the smaller name first on a tie."""
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name"))
        .agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "name")
    )
    return counts if n is None else counts.limit(n)


def kpi_stats(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(metric, total, avg, max, min) from one wide aggregate, turned long on its single row."""
    metrics = metrics or metric_columns(df)
    parts = []
    for i, m in enumerate(metrics):
        value = F.col(m).cast("double")
        parts += [
            total(F.col(m)).alias(f"t{i}"), F.avg(value).alias(f"a{i}"),
            F.max(value).alias(f"x{i}"), F.min(value).alias(f"n{i}"),
        ]
    return fan_out(df.agg(*parts), [], list(enumerate(metrics)), lambda item: {
        "metric": F.lit(item[1]), "total": F.col(f"t{item[0]}"), "avg": F.col(f"a{item[0]}"),
        "max": F.col(f"x{item[0]}"), "min": F.col(f"n{item[0]}"),
    })


# Overall ratios as (name, numerator, denominator, factor).
OVERALL_RATIOS = [
    ("overall_ctr", "clicks", "impressions", 100.0),
    ("overall_cpc", "spend", "clicks", 1.0),
    ("overall_cpm", "spend", "impressions", 1000.0),
    ("overall_conversion_rate", "conversions", "clicks", 100.0),
    ("overall_cpa", "spend", "conversions", 1.0),
    ("overall_roas", "revenue", "spend", 1.0),
]
# Totals reported as whole numbers, and as money.
WHOLE_TOTALS = ["impressions", "clicks", "conversions", "visits", "unique_visitors", "foot_traffic"]
MONEY_TOTALS = ["spend", "revenue"]


def _sums(df: DataFrame) -> tuple[list[str], DataFrame]:
    have = [m for m in [*WHOLE_TOTALS, *MONEY_TOTALS] if m in df.columns]
    return have, df.agg(*([total(F.col(m)).alias(m) for m in have] or [F.count(F.lit(1)).alias("__rows")]))


def _ratio_items(have: list[str]) -> list[tuple[str, Column]]:
    return [
        (name, ratio_or_zero(F.col(num), F.col(den), factor, 4))
        for name, num, den, factor in OVERALL_RATIOS
        if num in have and den in have
    ]


def _total_items(have: list[str]) -> list[tuple[str, Column]]:
    items = []
    for m in have:
        if m == "clicks" and "impressions" not in have:
            continue  # typed click totals come with impressions only
        shown = settled(F.col(m), 2) if m in MONEY_TOTALS else F.col(m).cast("bigint").cast("double")
        items.append((f"total_{m}", shown))
    return items


def _kpi_rows(wide: DataFrame, items: list[tuple[str, Column]]) -> DataFrame:
    if not items:
        return wide.select(F.lit("").alias("kpi"), F.lit(0.0).alias("value")).where(F.lit(False))
    return fan_out(wide, [], items, lambda item: {"kpi": F.lit(item[0]), "value": item[1]})


def overall_ratios(df: DataFrame) -> DataFrame:
    """(kpi, value): ratios of the sums, four digits; 0 when the denominator's sum is not positive."""
    have, wide = _sums(df)
    return _kpi_rows(wide, _ratio_items(have))


def typed_totals(df: DataFrame) -> DataFrame:
    """(kpi, value): counts truncated to whole numbers, money to cents."""
    have, wide = _sums(df)
    return _kpi_rows(wide, _total_items(have))


def kpi_overall(df: DataFrame) -> DataFrame:
    """(kpi, value): typed totals and overall ratios from one aggregate."""
    have, wide = _sums(df)
    return _kpi_rows(wide, _total_items(have) + _ratio_items(have))


def kpi_overall_from(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """kpi_overall() from a stored kpi_stats() of these metrics, without reading the table again."""
    have = [m for m in [*WHOLE_TOTALS, *MONEY_TOTALS] if m in metrics]
    wide = stats.agg(*([F.max(F.when(F.col("metric") == m, F.col("total"))).alias(m) for m in have] or [F.count(F.lit(1)).alias("__rows")]))
    return _kpi_rows(wide, _total_items(have) + _ratio_items(have))


def exact_totals(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(metric, total): sums of whole metrics as decimal(38,2), exact at any size and in any order of rows.

    Fractions are rounded to cents row by row first, which is exact for money.
    """
    metrics = metrics or metric_columns(df)
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    value = lambda m: F.col(m).cast("decimal(20,0)") if m in whole else F.col(m).cast("decimal(28,2)")
    sums = df.agg(*[F.coalesce(F.sum(value(m)), F.lit(0)).cast("decimal(38,2)").alias(f"t{i}") for i, m in enumerate(metrics)])
    return fan_out(sums, [], list(enumerate(metrics)), lambda item: {"metric": F.lit(item[1]), "total": F.col(f"t{item[0]}")})


def daily_sums(stored: DataFrame) -> DataFrame:
    """(date, <metric> ...): the sums of a stored daily() under the metrics' own names, for operators over time."""
    sums = [c for c in stored.columns if c.endswith("_sum")]
    return stored.select("date", *[F.col(c).alias(c.removesuffix("_sum")) for c in sums])


def dimension_sums(stored: DataFrame, metrics: list[str]) -> DataFrame:
    """(dimension, metric, name, value) from a stored by_dimension()."""
    named = stored.select("dimension", "name", *[F.col(f"{m}_sum").alias(m) for m in metrics])
    return named.unpivot(["dimension", "name"], metrics, "metric", "value").select("dimension", "metric", "name", "value")


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, column kinds, missing cells, first and last time, whole days between."""
    time = time_axis(df)
    missing = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    parts = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing")]
    if time:
        at = F.col(time).cast("timestamp_ntz")
        parts += [F.min(at).alias("first"), F.max(at).alias("last")]
    else:
        parts += [F.lit(None).cast("timestamp_ntz").alias("first"), F.lit(None).cast("timestamp_ntz").alias("last")]
    return summary_row(df.agg(*parts), df)


def summary_row(counted: DataFrame, df: DataFrame) -> DataFrame:
    """The summary from one row (rows, missing, first, last); of ``df`` only the schema counts."""
    width = len(df.columns)
    cells = F.col("rows") * F.lit(width)
    seconds = F.expr("timestampdiff(SECOND, first, last)")
    return counted.select(
        F.col("rows").alias("total_rows"),
        F.lit(width).alias("total_columns"),
        F.lit(len(metric_columns(df))).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("categorical_columns"),
        F.lit(len(time_columns(df))).alias("datetime_columns"),
        F.col("missing").alias("missing_values"),
        F.coalesce(settled(ratio(F.col("missing"), cells, 100.0), 2), F.lit(0.0)).alias("missing_percentage"),
        F.col("first").alias("date_range_start"),
        F.col("last").alias("date_range_end"),
        F.floor(seconds / 86400).cast("bigint").alias("total_days"),
    )
