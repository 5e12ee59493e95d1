"""Period-over-period change: the first half of the date range against the second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediatally.functions.numbers import settled, total
from mediatally.operators.roles import metric_columns, time_axis

MIN_RANGE_DAYS = 2


def period_split(df: DataFrame, metrics: list[str] | None = None, time: str | None = None) -> DataFrame:
    """(metric, day, value, first_date, mid_date, last_date): daily totals with the period borders.

    The table is read once: it is reduced to daily totals, and borders and periods come from those. A
    metric's window holds one row per calendar day, whatever the size of the table.
    """
    metrics, time = metrics or metric_columns(df), time or time_axis(df)
    day = F.to_date(F.col(time))
    days = (
        df.select(day.alias("__day"), *metrics).where(F.col("__day").isNotNull())
        .groupBy("__day").agg(*[total(F.col(m)).alias(m) for m in metrics])
        .unpivot(["__day"], metrics, "metric", "value").withColumnRenamed("__day", "day")
    )
    whole = Window.partitionBy("metric")
    borders = days.withColumn("first_date", F.min("day").over(whole)).withColumn("last_date", F.max("day").over(whole))
    span = F.datediff("last_date", "first_date")
    return borders.where(span >= MIN_RANGE_DAYS).withColumn(
        "mid_date", F.date_add("first_date", F.expr("datediff(last_date, first_date) div 2").cast("int"))
    )


def period_comparison(df: DataFrame, metrics: list[str] | None = None, time: str | None = None) -> DataFrame:
    """(metric, period1_total, period2_total, change_pct, first_date, mid_date, last_date).

    Days before mid_date against days from mid_date on; no rows when the dates span less than two days.
    Change is relative to period 1; when that is not positive it is 100 for a positive period 2, else 0.
    """
    early = F.col("day") < F.col("mid_date")
    zero = F.lit(0.0)
    totals = period_split(df, metrics, time).groupBy("metric", "first_date", "mid_date", "last_date").agg(
        F.sum(F.when(early, F.col("value")).otherwise(zero)).alias("p1"),
        F.sum(F.when(~early, F.col("value")).otherwise(zero)).alias("p2"),
    )
    p1, p2 = F.col("p1"), F.col("p2")
    change = F.when(p1 > 0, F.try_divide(p2 - p1, p1) * 100).otherwise(F.when(p2 > 0, 100.0).otherwise(0.0))
    return totals.select(
        "metric",
        settled(p1, 2).alias("period1_total"),
        settled(p2, 2).alias("period2_total"),
        settled(change, 2).alias("change_pct"),
        "first_date", "mid_date", "last_date",
    )
