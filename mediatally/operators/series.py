"""Daily series for line charts, and their trend lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediatally.functions.numbers import total
from mediatally.operators.roles import SERIES_METRICS, available, time_axis


def daily_series(df: DataFrame, metrics: list[str] | None = None, limit: int = 4) -> DataFrame:
    """(date, one column per metric): daily sums of the first available metrics, sorted by date."""
    chosen = available(df, SERIES_METRICS if metrics is None else metrics)[:limit]
    day = F.to_date(F.col(time_axis(df)))
    rows = df.select(day.alias("date"), *chosen).where(F.col("date").isNotNull())
    return rows.groupBy("date").agg(*[total(F.col(m)).alias(m) for m in chosen]).orderBy("date")


def trend_lines(series: DataFrame) -> DataFrame:
    """(metric, slope, intercept, points): least squares over the day's index, for series of more than two days.

    ``series`` is a daily table, so a metric's window holds one row per calendar day.
    """
    metrics = [c for c in series.columns if c != "date"]
    long = series.unpivot(["date"], metrics, "metric", "value")
    index = F.row_number().over(Window.partitionBy("metric").orderBy("date")) - 1
    lines = long.withColumn("i", index.cast("double")).groupBy("metric").agg(
        F.regr_slope("value", "i").alias("slope"),
        F.regr_intercept("value", "i").alias("intercept"),
        F.count(F.lit(1)).alias("points"),
    )
    return lines.where("points > 2")


def trend_points(series: DataFrame) -> DataFrame:
    """(date, metric, value, trend): the series in long form beside its trend line."""
    metrics = [c for c in series.columns if c != "date"]
    long = series.unpivot(["date"], metrics, "metric", "value")
    index = F.row_number().over(Window.partitionBy("metric").orderBy("date")) - 1
    lines = trend_lines(series)
    return (
        long.withColumn("i", index).join(F.broadcast(lines), "metric", "left")
        .select("date", "metric", "value", (F.col("slope") * F.col("i") + F.col("intercept")).alias("trend"))
    )
