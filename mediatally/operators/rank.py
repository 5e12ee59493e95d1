"""Rankings: top names per dimension and metric, segment shares, and the chart cuts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatally.functions.labels import title_label
from mediatally.functions.numbers import ratio, settled, total
from mediatally.operators.aggregate import dimension_totals
from mediatally.operators.roles import (
    RANKED_METRICS, SEGMENT_METRICS, available, dimension_columns, segment_column, text_columns,
)

TOP_N = 5
SEGMENTS = 8


def _dimensions(df: DataFrame, dimensions: list[str] | str | None) -> list[str]:
    if dimensions == "all":
        return text_columns(df)
    return dimension_columns(df) if dimensions is None else list(dimensions)


def top_performers(
    df: DataFrame,
    dimensions: list[str] | str | None = None,
    metrics: list[str] | None = None,
    n: int = TOP_N,
    totals: DataFrame | None = None,
) -> DataFrame:
    """(dimension, metric, rank, name, value): the n largest sums per dimension and metric.

    ``totals`` is a stored (dimension, metric, name, value) of the sums; then the table is not read.

    Default dimensions are the text columns with a dimension word in their name; ``"all"`` takes every
    text column. Dimensions with one single value are left out. Ties go to the smaller name.

    One scan and one aggregate serve all lists; Spark keeps only the leading rows of each list per task
    before the ranking shuffle (window group limit). Every name has a sum for every metric, so "more than one value"
    shows as a second row in the list and needs no distinct count.
    """
    dimensions = _dimensions(df, dimensions)
    metrics = available(df, RANKED_METRICS) if metrics is None else metrics
    totals = dimension_totals(df, dimensions, metrics) if totals is None else totals
    best = Window.partitionBy("dimension", "metric").orderBy(F.desc("value"), "name")
    leading = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(n, 2))
    whole_list = Window.partitionBy("dimension", "metric")
    return (
        leading.withColumn("__rows", F.count(F.lit(1)).over(whole_list))
        .where((F.col("__rows") > 1) & (F.col("rank") <= n))
        .select("dimension", "metric", "rank", "name", settled(F.col("value"), 2).alias("value"))
    )


def list_order(dimensions: list[str], metrics: list[str]) -> Column:
    """Position of a (dimension, metric) list: dimensions in column order, metrics in priority order."""
    d = F.array_position(F.array(*[F.lit(x) for x in dimensions]), F.col("dimension"))
    m = F.array_position(F.array(*[F.lit(x) for x in metrics]), F.col("metric"))
    return d * F.lit(1000) + m


def first_top_list(top: DataFrame, dimensions: list[str], metrics: list[str] | None = None) -> DataFrame:
    """The bars of the first non-empty list: (title, rank, name, value).

    ``top`` holds at most n rows per dimension and metric, so the window over it is as small as the schema.
    """
    lists = F.dense_rank().over(Window.orderBy(list_order(dimensions, metrics or RANKED_METRICS)))
    title = F.concat(F.lit("Top "), title_label(F.col("dimension")), F.lit(" By "), title_label(F.col("metric")))
    return top.withColumn("__list", lists).where(F.col("__list") == 1).select(title.alias("title"), "rank", "name", "value")


def top_segments(
    df: DataFrame, dimension: str | None = None, metric: str | None = None, n: int = SEGMENTS
) -> DataFrame:
    """(dimension, measure, rank, name, value, share_pct): largest segments and their share of those shown.

    Dimension and metric default to the first match of the priority lists; without any metric rows are
    counted.
    """
    dimension = dimension or segment_column(df)
    metric = metric or next(iter(available(df, SEGMENT_METRICS)), None)
    value = total(F.col(metric)) if metric else F.count(F.lit(1)).cast("double")
    sums = (
        df.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("name")).agg(value.alias("value"))
        .orderBy(F.desc("value"), "name").limit(n)
    )
    # At most n rows from here on.
    shown = Window.orderBy(F.desc("value"), "name")
    return sums.select(
        F.lit(dimension).alias("dimension"),
        F.lit(metric or "count").alias("measure"),
        F.row_number().over(shown).alias("rank"),
        "name",
        settled(F.col("value"), 2).alias("value"),
        settled(ratio(F.col("value"), F.sum("value").over(Window.partitionBy()), 100.0), 1).alias("share_pct"),
    )


def nonzero_comparison(comparison: DataFrame) -> DataFrame:
    """Comparison rows where either period is positive."""
    return comparison.where("period1_total > 0 or period2_total > 0")


def comparison_bars(comparison: DataFrame, metrics: list[str], n: int = 6) -> DataFrame:
    """(pos, label, period1_total, period2_total, change_pct): the first n non-zero metrics in column order."""
    position = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    ranked = nonzero_comparison(comparison).withColumn("pos", F.row_number().over(Window.orderBy(position)))
    return ranked.where(F.col("pos") <= n).select(
        "pos", title_label(F.col("metric")).alias("label"), "period1_total", "period2_total", "change_pct"
    )
