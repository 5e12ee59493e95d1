"""Z-score anomalies: a statistics pass, then a counting pass; no window over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatally.functions.numbers import half_even, ratio, settled
from mediatally.operators.reshape import fan_out
from mediatally.operators.roles import metric_columns

THRESHOLD = 2.0
MIN_VALUES = 3


def usable_metrics(df: DataFrame, metrics: list[str] | None = None, min_values: int = MIN_VALUES) -> DataFrame:
    """(metric, values): metrics with enough non-null values to be judged."""
    metrics = metrics or metric_columns(df)
    wide = df.agg(*[F.count(m).alias(f"n{i}") for i, m in enumerate(metrics)])
    long = fan_out(wide, [], list(enumerate(metrics)), lambda item: {
        "metric": F.lit(item[1]), "values": F.col(f"n{item[0]}"),
    })
    return long.where(F.col("values") >= min_values)


def _z(value: Column, mean: Column, deviation: Column) -> Column:
    """Distance from the mean in deviations; null, so never flagged, for a constant metric."""
    return F.abs(F.try_divide(value - mean, deviation))


def beyond(value: Column, mean: Column, deviation: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a value lies beyond the threshold; null for a missing one and for a constant metric."""
    return _z(value, mean, deviation) > threshold


def anomalies(
    df: DataFrame, metrics: list[str] | None = None, threshold: float = THRESHOLD, min_values: int = MIN_VALUES
) -> DataFrame:
    """(metric, count, percentage, mean, std) of metrics having at least one value with |z| > threshold.

    z uses the population deviation, the reported std is the sample deviation; constant metrics are never
    flagged. Both passes are wide one-row aggregates, so rows are never multiplied. Each pass has two
    aggregates per metric: four per metric in one pass took wide tables out of compiled code (2.1 s against
    0.6 s for 17 metrics at 600,000 rows), so counts come with the second pass and the sample deviation
    follows from them.
    """
    metrics = metrics or metric_columns(df)
    indexed = list(enumerate(metrics))
    values = df.select(*[F.col(m).cast("double").alias(f"v{i}") for i, m in indexed])
    stats = values.agg(*[
        part for i, _ in indexed
        for part in (F.avg(f"v{i}").alias(f"mean{i}"), F.stddev_pop(f"v{i}").alias(f"sd{i}"))
    ])
    counts = values.crossJoin(F.broadcast(stats)).agg(*[
        part for i, _ in indexed
        for part in (
            F.count_if(_z(F.col(f"v{i}"), F.col(f"mean{i}"), F.col(f"sd{i}")) > threshold).alias(f"c{i}"),
            F.count(f"v{i}").alias(f"n{i}"),
        )
    ])

    def fields(item: tuple[int, str]) -> dict[str, Column]:
        i, metric = item
        n, flagged = F.col(f"n{i}"), F.col(f"c{i}")
        sample = F.col(f"sd{i}") * F.sqrt(F.try_divide(n.cast("double"), (n - 1).cast("double")))
        return {
            "metric": F.lit(metric), "count": flagged, "percentage": settled(ratio(flagged, n, 100.0), 2),
            "mean": settled(F.col(f"mean{i}"), 2), "std": settled(sample, 2), "__n": n,
        }

    rows = fan_out(counts.crossJoin(F.broadcast(stats)), [], indexed, fields)
    return rows.where((F.col("count") > 0) & (F.col("__n") >= min_values)).drop("__n")


def anomaly_values(
    df: DataFrame,
    order_by: list[str],
    metrics: list[str] | None = None,
    threshold: float = THRESHOLD,
    min_values: int = MIN_VALUES,
    first: int = 5,
    facts: DataFrame | None = None,
) -> DataFrame:
    """(metric, pos, value): the first flagged values of each metric in row order; with stored facts of the table one scan.

    Values are flagged beside the one-row statistics and only flagged ones are laid out long; Spark keeps
    only ``first`` of them per metric in each task before the ranking shuffle (window group limit).
    """
    metrics = metrics or metric_columns(df)
    indexed = list(enumerate(metrics))
    # |z| over n values is at most sqrt(n - 1), so a usual threshold already rules out short metrics.
    counted = threshold**2 < min_values - 2
    order = [f"o{i}" for i in range(len(order_by))]
    rows = df.select(
        *[F.col(c).alias(o) for c, o in zip(order_by, order)],
        *[F.col(m).cast("double").alias(f"v{i}") for i, m in indexed],
    )
    if facts is None:
        stats = rows.agg(*[
            part for i, _ in indexed
            for part in (
                F.avg(f"v{i}").alias(f"mean{i}"), F.stddev_pop(f"v{i}").alias(f"sd{i}"),
                *([F.count(f"v{i}").alias(f"n{i}")] if counted else []),
            )
        ])
    else:
        of = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column)))
        stats = facts.agg(*[
            of(m, column).alias(f"{name}{i}")
            for i, m in indexed for name, column in (("mean", "avg"), ("sd", "deviation"), ("n", "n"))
        ])

    def flagged(i: int) -> Column:
        beyond = _z(F.col(f"v{i}"), F.col(f"mean{i}"), F.col(f"sd{i}")) > threshold
        return F.when(beyond & (F.col(f"n{i}") >= min_values) if counted else beyond, F.col(f"v{i}"))

    long = (
        rows.crossJoin(F.broadcast(stats))
        .select(F.struct(*order).alias("row"), F.posexplode(F.array(*[flagged(i) for i, _ in indexed])).alias("i", "value"))
        .where(F.col("value").isNotNull())
    )
    ranked = long.withColumn("pos", F.row_number().over(Window.partitionBy("i").orderBy("row")))
    name = F.get(F.array(*[F.lit(m) for m in metrics]), F.col("i"))
    return ranked.where(F.col("pos") <= first).select(name.alias("metric"), "pos", half_even(F.col("value"), 2).alias("value"))
