"""Missing values: profile, median fill, mode fill, 'Unknown' fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatally.functions.numbers import nan_to_null, ratio
from mediatally.operators.fill import RANGES, fill_times
from mediatally.operators.quantile import medians
from mediatally.operators.reshape import fan_out
from mediatally.operators.roles import metric_columns, text_columns, time_columns
from mediatally.session import staged


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """One notion of missing from here on: NaN becomes null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    # Headers come here as they stand in the file, so names may hold dots and the like.
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    return df.select(*[(nan_to_null(q) if c in floats else q).alias(c) for c, q in quoted.items()])


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct), one aggregate over the table."""
    columns = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"__m{i}") for i, c in enumerate(columns)],
    )
    return fan_out(wide, [], list(enumerate(columns)), lambda item: {
        "column": F.lit(item[1]),
        "missing": F.col(f"__m{item[0]}"),
        "missing_pct": F.coalesce(ratio(F.col(f"__m{item[0]}"), F.col("__rows"), 100.0), F.lit(0.0)),
    })


def missing_total(df: DataFrame) -> DataFrame:
    """One row: missing cells over all columns, and rows."""
    cells = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(cells), F.lit(0)).alias("missing"), F.count(F.lit(1)).alias("rows"))


def modes(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, mode): most frequent non-null text, the smallest one on a tie.

    Counts are grouped by (column, value) first, so partial aggregation absorbs a hot value and no buffer
    holds a whole column; the pick itself is a mergeable minimum.
    """
    by = by or []
    counts = (
        df.select(*by, *columns).unpivot(by, columns, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("rows"))
    )
    pick = F.min(F.struct((-F.col("rows")).alias("order"), F.col("value")))
    return counts.groupBy(*by, "column").agg(pick["value"].alias("mode"))


def _wide(long: DataFrame, by: list[str], key: str, value: str, columns: list[str], prefix: str) -> DataFrame:
    """One row per ``by`` group with one column per name; bounded by columns x groups."""
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col(key) == c, F.col(value))).alias(f"{prefix}{c}") for c in columns]
    )


def _attach(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Put the statistics beside every row: one row in all, or one for each of a few groups.

    They go to the rows. Rows dealt by group would be in as many tasks as there are groups.
    """
    return df.join(F.broadcast(stats), by, "left") if by else df.crossJoin(F.broadcast(stats))


def fill_medians(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Null metrics take the exact median of their column (as double); an all-null column stays null.

    The table is evaluated once, into a stage table; ``stored`` says that it is one, or cheap to read off one.
    """
    by = by or []
    columns = columns if columns is not None else metric_columns(df)
    if not columns:
        return df
    df = df if stored else staged(df, "fill-table")
    stats = _wide(medians(df, columns, by, True), by, "metric", "median", columns, "__median_")
    order = df.columns
    filled: dict[str, Column] = {
        c: F.coalesce(F.col(c).cast("double"), F.col(f"__median_{c}")) for c in columns
    }
    return _attach(df, stats, by).withColumns(filled).select(*order)


def fill_modes(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Null text takes the column's mode, or 'Unknown' when the column holds no value at all."""
    by = by or []
    texts = columns if columns is not None else text_columns(df)
    columns = [c for c in texts if c not in by]
    if not columns:
        return df
    stats = _wide(modes(df, columns, by), by, "column", "mode", columns, "__mode_")
    order = df.columns
    filled = {c: F.coalesce(F.col(c), F.col(f"__mode_{c}"), F.lit("Unknown")) for c in columns}
    return _attach(df, stats, by).withColumns(filled).select(*order)


def columns_with_gaps(df: DataFrame) -> set[str]:
    """Columns that hold a null, from one aggregate over the table."""
    row = df.agg(*[F.bool_or(F.col(f"`{c}`").isNull()).alias(f"__g{i}") for i, c in enumerate(df.columns)]).first()
    return {c for i, c in enumerate(df.columns) if row[i]}


def fill_missing(
    df: DataFrame, order_by: list[str] | None = None, scope: str | None = None, ranges: int | None = RANGES, stored: bool = False
) -> DataFrame:
    """Fill by type: metrics with the median, text with the mode, time columns forward then backward.

    ``scope=None`` takes statistics over the whole table. ``scope="data_source_type"`` takes them per
    source, so that a metric one source does not have stays null there instead of being made up; a table without
    that column has one source. Only columns with nulls are worked on, as a first aggregate shows.

    The table is evaluated once, into a stage table; ``stored`` says that it is one.

    Time columns are filled in the order that ``order_by`` names. Nulls come first in an order, so a time column that is
    itself the first of them, as each is when no order is given, takes its earliest value.
    """
    df = df if stored else staged(df, "fill-table")
    gaps = columns_with_gaps(df)
    times = [c for c in time_columns(df) if c in gaps]
    leading = [c for c in times if c == (order_by or [c])[0]]
    inner = [c for c in times if c not in leading]
    if inner:
        # Columns are filled independently; times go first so that their bounds job reads the plain table.
        df = fill_times(df, inner, order_by, ranges, stored=True)
    if leading:
        names, first = df.columns, df.agg(*[F.min(c).alias(f"__first_{c}") for c in leading])
        filled = {c: F.coalesce(c, f"__first_{c}") for c in leading}
        df = df.crossJoin(F.broadcast(first)).withColumns(filled).select(*names)
    by = [scope] if scope and scope in df.columns else []
    metrics = metric_columns(df)
    df = fill_medians(df, [c for c in metrics if c in gaps], by, stored=True)
    df = df.withColumns({c: F.col(c).cast("double") for c in metrics})
    return fill_modes(df, [c for c in text_columns(df) if c in gaps], by)
