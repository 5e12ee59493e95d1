"""Exact medians of many columns at any size.

A built-in exact percentile keeps every distinct value of a column in one aggregation buffer. Here
the rank is located in steps whose state is bounded, and every step is a map-side-combined
aggregate:

1. a mergeable sketch gives a narrow bracket around the median, plus the exact count;
2. the values below and inside each bracket are counted, and an exact histogram (at most BUCKETS rows per column) of the
   values inside shows which bucket holds the middle ranks;
3. only the values of that bucket are grouped and ranked.

The columns are laid out once, counts certify that both middle ranks lie inside the bracket, and a bracket that fails is
opened to the smallest or largest value on that side, so the result never rests on the sketch's error. Only values inside a
bracket, a few in ten thousand where the sketch was right, are laid out long. Over a whole table the brackets are literals; by
group they are a small table, a row for each group, that goes to every task, so no task gets a group's rows together.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatally.session import staged

BUCKETS = 4096
ACCURACY = 10000
MARGIN = 2.0 / ACCURACY


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """Bucket number, never decreasing in value: 0 below the bracket, BUCKETS + 1 above it."""
    share = F.try_divide(value - low, high - low)
    inside = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
    return F.when(value < low, F.lit(0)).when(value > high, F.lit(BUCKETS + 1)).otherwise(inside + 1)


class Bracket(NamedTuple):
    n: int
    least: float
    low: float
    high: float
    most: float


def _sketched(values: DataFrame) -> list[Bracket | None]:
    """A bracket for each column, None for one without values."""
    stats = []
    for c in values.columns:
        stats += [F.count(c), F.min(c), F.percentile_approx(c, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY), F.max(c)]
    row = values.agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)]).first()
    fours = [row[i : i + 4] for i in range(0, len(row), 4)]
    return [Bracket(n, least, *around, most) if n else None for n, least, around, most in fours]


def _certified(values: DataFrame, found: list[Bracket | None]) -> list[tuple[Bracket, int] | None]:
    """The brackets, opened on the side where a middle rank lies outside, and how many values lie below each."""
    counts = []
    for c, f in zip(values.columns, found):
        low, high = (F.lit(f.low), F.lit(f.high)) if f else (F.lit(0.0), F.lit(0.0))
        counts += [F.count_if(F.col(c) < low), F.count_if(F.col(c) <= high)]
    row = values.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)]).first()
    out: list[tuple[Bracket, int] | None] = []
    for i, f in enumerate(found):
        if f is None:
            out.append(None)
            continue
        below, up_to = row[2 * i], row[2 * i + 1]
        if (f.n - 1) // 2 < below:
            f, below = f._replace(low=f.least), 0
        if f.n // 2 >= up_to:
            f = f._replace(high=f.most)
        out.append((f, below))
    return out


def _laid_out(df: DataFrame, columns: list[str], by: list[str], stored: bool) -> DataFrame:
    """The columns as doubles v0, v1, ... beside the groups, evaluated once; a ``stored`` table is read where it is."""
    values = df.select(*by, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    return values if stored else staged(values, "median-columns")


def _inside(df: DataFrame, columns: list[str], stored: bool) -> DataFrame:
    """(metric, n, below, value, bucket) of the values inside the brackets; the table stays wide."""
    values = _laid_out(df, columns, [], stored)
    held = [(i, c, *f) for i, (c, f) in enumerate(zip(columns, _certified(values, _sketched(values)))) if f]
    if not held:
        return values.sparkSession.createDataFrame([], "metric string, n bigint, below bigint, value double, bucket int")

    def cell(i: int, c: str, f: Bracket, below: int) -> Column:
        value, low, high = F.col(f"v{i}"), F.lit(f.low), F.lit(f.high)
        return F.when(value.between(low, high), F.struct(
            F.lit(c).alias("metric"), F.lit(f.n).cast("bigint").alias("n"), F.lit(below).cast("bigint").alias("below"),
            value.alias("value"), _bucket(value, low, high).alias("bucket"),
        ))

    any_inside = reduce(lambda a, b: a | b, [F.col(f"v{i}").between(f.low, f.high) for i, _, f, _ in held])
    return values.where(any_inside).select(F.inline(F.filter(F.array(*[cell(*h) for h in held]), lambda c: c.isNotNull())))


def _sketched_by(values: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., b0, b1, ...): the bracket of each column, a row for each group."""
    found = [
        F.struct(F.count(c).alias("n"), F.min(c).alias("least"), F.percentile_approx(c, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY).alias("around"), F.max(c).alias("most"))
        for c in columns
    ]
    wide = values.groupBy(*by).agg(*[f.alias(f"b{i}") for i, f in enumerate(found)])
    bracket = lambda b: F.struct(
        F.col(f"{b}.n").alias("n"), F.col(f"{b}.least").alias("least"), F.get(F.col(f"{b}.around"), F.lit(0)).alias("low"),
        F.get(F.col(f"{b}.around"), F.lit(1)).alias("high"), F.col(f"{b}.most").alias("most"),
    )
    return wide.select(*by, *[bracket(f"b{i}").alias(f"b{i}") for i in range(len(columns))])


def _certified_by(values: DataFrame, found: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., b0, ...) with the brackets opened where a middle rank lies outside, and how many values lie below each."""
    counts = values.join(F.broadcast(found), by).groupBy(*by).agg(*[
        F.struct(F.count_if(F.col(c) < F.col(f"b{i}.low")).alias("below"), F.count_if(F.col(c) <= F.col(f"b{i}.high")).alias("up_to")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ])

    def opened(i: int) -> Column:
        n, below, up_to = F.col(f"b{i}.n"), F.col(f"c{i}.below"), F.col(f"c{i}.up_to")
        under, over = F.floor((n - 1) / 2) < below, F.floor(n / 2) >= up_to
        return F.struct(
            n.alias("n"), F.when(under, F.lit(0)).otherwise(below).cast("bigint").alias("below"),
            F.when(under, F.col(f"b{i}.least")).otherwise(F.col(f"b{i}.low")).alias("low"),
            F.when(over, F.col(f"b{i}.most")).otherwise(F.col(f"b{i}.high")).alias("high"),
        )

    return found.join(F.broadcast(counts), by).select(*by, *[opened(i).alias(f"b{i}") for i in range(len(columns))])


def _inside_by(df: DataFrame, columns: list[str], by: list[str], stored: bool) -> DataFrame:
    """(by..., metric, n, below, value, bucket) of the values inside the brackets of their group; a null group has none."""
    values, names = _laid_out(df, columns, by, stored), [f"v{i}" for i in range(len(columns))]
    found = staged(_sketched_by(values, names, by), "median-brackets")
    certified = staged(_certified_by(values, found, names, by), "median-certified")

    def cell(i: int) -> Column:
        value, low, high = F.col(f"v{i}"), F.col(f"b{i}.low"), F.col(f"b{i}.high")
        return F.when(value.between(low, high), F.struct(
            F.lit(columns[i]).alias("metric"), F.col(f"b{i}.n").alias("n"), F.col(f"b{i}.below").alias("below"),
            value.alias("value"), _bucket(value, low, high).alias("bucket"),
        ))

    any_inside = reduce(lambda a, b: a | b, [F.col(c).between(F.col(f"b{i}.low"), F.col(f"b{i}.high")) for i, c in enumerate(names)])
    cells = F.filter(F.array(*[cell(i) for i in range(len(columns))]), lambda c: c.isNotNull())
    return values.join(F.broadcast(certified), by).where(any_inside).select(*by, F.inline(cells))


def medians(df: DataFrame, columns: list[str], by: list[str] | None = None, stored: bool = False) -> DataFrame:
    """(by..., metric, median) with the two middle values averaged; all-null columns give no row.

    ``by`` must name low-cardinality, non-null columns such as the source tag. ``stored`` says that the table is a stage
    table, whose columns need not be laid out again.
    """
    by = by or []
    keys = [*by, "metric"]
    bucketed = _inside_by(df, columns, by, stored) if by else _inside(df, columns, stored)

    # 0-based ranks of the two middle values, among the values that are laid out.
    lower, upper = (F.expr(f"{r} - below") for r in ("(n - 1) div 2", "n div 2"))
    up_to = Window.partitionBy(*keys).orderBy("bucket")
    histogram = (
        bucketed.groupBy(*keys, "n", "below", "bucket").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("before", F.sum("rows").over(up_to) - F.col("rows"))
        .where((F.col("before") <= upper) & (lower < F.col("before") + F.col("rows")))
        .select(*keys, "bucket", "before")
    )

    in_order = Window.partitionBy(*keys).orderBy("bucket", "value")
    first = F.min("before").over(Window.partitionBy(*keys))
    ranked = (
        bucketed.join(F.broadcast(histogram), [*keys, "bucket"])  # two buckets per column and group at most
        .groupBy(*keys, "n", "below", "bucket", "value").agg(F.count(F.lit(1)).alias("rows"), F.min("before").alias("before"))
        .withColumn("before", first + F.sum("rows").over(in_order) - F.col("rows"))
    )

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("rows"))

    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(lower), F.col("value"))) + F.max(F.when(holds(upper), F.col("value")))) / 2)
        .alias("median")
    )
