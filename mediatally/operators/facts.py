"""What several report sections need from the whole table, from one scan: counts, sums, moments, extremes, cells, days.

Six figures for each of 17 metrics are more buffers than generated code takes (Spark leaves compiled code at 100 fields),
so each task turns its Arrow batches into one row per metric and Spark merges those rows. The tables of statistics,
overall KPIs, summary and the mean and deviation of the anomalies are cut from the result.

The second pass over the table that anomalies need (how many values lie beyond the threshold) is one column per metric
in the aggregate per day.

Defined results: nulls and NaN are missing values; an empty table has one row per metric with n = 0, total 0 and null
mean and extremes; rows without a day are the day null.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatally.functions.numbers import ratio, settled, total
from mediatally.operators.aggregate import summary_row
from mediatally.operators.anomalies import MIN_VALUES, THRESHOLD, beyond
from mediatally.operators.reshape import fan_out
from mediatally.operators.roles import metric_columns, time_axis

# The task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARTS = "i int, n long, s double, mean double, m2 double, lo double, hi double, first timestamp_ntz, last timestamp_ntz"
_CELLS = -1  # the row of the table itself: n rows, s missing cells, first and last time


def _column_part(x: np.ndarray) -> tuple:
    x = x[~np.isnan(x)]
    if not len(x):
        return 0, 0.0, 0.0, 0.0, np.nan, np.nan
    mean = x.mean()
    return len(x), x.sum(), mean, np.square(x - mean).sum(), x.min(), x.max()


def _merged_part(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not n:
        return a
    step = b[2] - a[2]
    return (
        n, a[1] + b[1], a[2] + step * b[0] / n, a[3] + b[3] + step * step * a[0] * b[0] / n,
        np.fmin(a[4], b[4]), np.fmax(a[5], b[5]),
    )


def _task_facts(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, missing, times = [(0, 0.0, 0.0, 0.0, np.nan, np.nan)] * width, 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [_column_part(c.to_numpy(zero_copy_only=False).astype(np.float64)) for c in batch.columns[:width]]
            parts = [_merged_part(a, b) for a, b in zip(parts, found)]
            rows, missing = rows + batch.num_rows, missing + pc.sum(batch.column(width)).as_py()
            ends = pc.min_max(batch.column(width + 1)).as_py()
            times = [t for t in (*times, ends["min"], ends["max"]) if t is not None]
            times = [min(times), max(times)] if times else []
        lines = [(i, *p, None, None) for i, p in enumerate(parts)]
        lines.append((_CELLS, rows, float(missing), 0.0, 0.0, np.nan, np.nan, *(times or (None, None))))
        kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 5, *[pa.timestamp("us")] * 2]
        names = [field.strip().split(" ")[0] for field in _PARTS.split(",")]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*lines), kinds)], names=names)

    return run


def table_facts(df: DataFrame, metrics: list[str] | None = None, time: str | None = None) -> DataFrame:
    """(metric, n, total, avg, deviation, min, max, first, last) per metric, and a row with a null metric for the table:
    n its rows, total its missing cells, first and last its time. ``deviation`` is that of the population."""
    metrics, time = metrics or metric_columns(df), time or time_axis(df)
    missing = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    at = F.col(time) if time else F.lit(None)
    values = df.select(
        *[F.col(m).cast("double").alias(f"v{i}") for i, m in enumerate(metrics)],
        missing.alias("missing"), at.cast("timestamp_ntz").alias("at"),
    )
    parts = values.mapInArrow(_task_facts(len(metrics)), _PARTS)
    # The rows of an empty table, so that every metric is there.
    indexed = df.sparkSession.range(_CELLS, len(metrics), 1, 1).select(
        F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("n"),
        *[F.lit(0.0).alias(c) for c in ("s", "mean", "m2")], *[F.lit(None).cast("double").alias(c) for c in ("lo", "hi")],
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("first", "last")],
    )
    parts = parts.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("lo", "hi")}).unionByName(indexed)
    of_metric = Window.partitionBy("i")
    whole = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(of_metric), F.sum("n").over(of_metric))
    centred = parts.withColumn("whole", whole)
    off = F.col("mean") - F.col("whole")
    merged = centred.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("total"), F.max("whole").alias("avg"),
        F.sqrt(F.try_divide(F.sum(F.col("m2") + F.col("n") * off * off), F.sum("n"))).alias("deviation"),
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    # The deviation of a constant metric is zero, not the rounding of its mean.
    merged = merged.withColumn("deviation", F.when(F.col("min") == F.col("max"), F.lit(0.0)).otherwise(F.col("deviation")))
    name = F.when(F.col("i") >= 0, F.get(F.array(*[F.lit(m) for m in metrics]), F.col("i"))) if metrics else F.lit(None).cast("string")
    return merged.select(name.alias("metric"), "n", "total", "avg", "deviation", "min", "max", "first", "last")


def stats_from(facts: DataFrame) -> DataFrame:
    """kpi_stats() from stored facts."""
    return facts.where(F.col("metric").isNotNull()).select("metric", "total", "avg", "max", "min")


def summary_from(facts: DataFrame, df: DataFrame) -> DataFrame:
    """summary() from stored facts; of ``df`` only the schema counts."""
    row = facts.where(F.col("metric").isNull())
    return summary_row(row.select(F.col("n").alias("rows"), F.col("total").cast("bigint").alias("missing"), "first", "last"), df)


def days_with_flags(
    df: DataFrame, facts: DataFrame, metrics: list[str] | None = None, time: str | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """(date, <metric>_sum, _count, _flagged ...): sums, present values and values beyond the threshold of each day; ``date``
    is null for rows without a time.

    The stored facts, one row per metric, are read first, so that means and deviations are constants of the aggregate.
    """
    metrics, time = metrics or metric_columns(df), time or time_axis(df)
    known = {r.metric: r for r in facts.where(F.col("metric").isin(metrics)).collect()}
    day = (F.to_date(F.col(time)) if time else F.lit(None).cast("date")).alias("date")
    rows = df.select(day, *[F.col(m).cast("double").alias(f"__v{i}") for i, m in enumerate(metrics)])
    parts: list[Column] = []
    for i, m in enumerate(metrics):
        value, mean, deviation = F.col(f"__v{i}"), known[m].avg, known[m].deviation
        flag = beyond(value, F.lit(mean), F.lit(deviation), threshold) if deviation else F.lit(False)
        parts += [total(value).alias(f"{m}_sum"), F.count(value).alias(f"{m}_count"), F.count_if(flag).alias(f"{m}_flagged")]
    return rows.groupBy("date").agg(*parts)


def _mean(m: str) -> Column:
    return F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_count")).alias(f"{m}_mean")


def daily_from(days: DataFrame, metrics: list[str]) -> DataFrame:
    """daily() from stored days_with_flags()."""
    return days.where(F.col("date").isNotNull()).select("date", *[c for m in metrics for c in (F.col(f"{m}_sum"), _mean(m))])


def weekly_from(days: DataFrame, metrics: list[str]) -> DataFrame:
    """weekly() from stored days_with_flags()."""
    dated = days.where(F.col("date").isNotNull()).withColumns({"__year": F.year("date"), "__week": F.weekofyear("date")})
    weeks = dated.groupBy("__year", "__week").agg(*[F.sum(f"{m}_{c}").alias(f"{m}_{c}") for m in metrics for c in ("sum", "count")])
    return weeks.select(
        F.col("__year").alias("year"), F.col("__week").alias("week"), *[c for m in metrics for c in (F.col(f"{m}_sum"), _mean(m))]
    )


def anomalies_from(facts: DataFrame, days: DataFrame, metrics: list[str], min_values: int = MIN_VALUES) -> DataFrame:
    """anomalies() from stored facts and stored days_with_flags()."""
    counted = days.agg(*[F.sum(f"{m}_flagged").alias(f"c{i}") for i, m in enumerate(metrics)])
    flagged = fan_out(counted, [], list(enumerate(metrics)), lambda item: {"metric": F.lit(item[1]), "count": F.col(f"c{item[0]}")})
    n = F.col("n")
    sample = F.col("deviation") * F.sqrt(F.try_divide(n.cast("double"), (n - 1).cast("double")))
    judged = flagged.where(F.col("count") > 0).join(F.broadcast(facts), "metric").where(n >= min_values)
    return judged.select(
        "metric", "count", settled(ratio(F.col("count"), n, 100.0), 2).alias("percentage"),
        settled(F.col("avg"), 2).alias("mean"), settled(sample, 2).alias("std"),
    )
