"""Combine tables: outer join on shared keys, or union by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatally.operators.names import normalise_names
from mediatally.session import staged

# Columns that may serve as merge keys, in priority order.
KEY_CANDIDATES = [
    "id", "date", "timestamp", "campaign_id", "location_id", "user_id", "customer_id", "region", "category",
]

SOURCE_TAG = "data_source_type"


def merge_keys(tables: list[DataFrame]) -> list[str]:
    """Key candidates present in every table, in candidate order."""
    shared = set.intersection(*[set(t.columns) for t in tables])
    return [c for c in KEY_CANDIDATES if c in shared]


def outer_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer equi-join; null keys match null keys, and on shared non-key columns the left side wins.

    Written as the matches plus the rows of either side without a partner. Spark can split a skewed
    partition on both sides of an inner join and on the left of an anti join at run time, but none of a full
    outer join, so one hot key, on whichever side, does not end in one task. The price is a second shuffle
    of each side; the anti joins meet the other side as distinct keys, reduced before they are shuffled.
    """
    right_only = [c for c in right.columns if c not in left.columns]
    left, right = _same_key_types(left, right, keys)
    right = right.select(*keys, *right_only)
    columns = [*left.columns, *right_only]

    l, r = left.alias("l"), right.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    matched = l.join(r, same, "inner").select("l.*", *[F.col(f"r.{c}") for c in right_only])
    left_alone = l.join(right.select(*keys).distinct().alias("r"), same, "left_anti").select("l.*")
    right_alone = r.join(left.select(*keys).distinct().alias("l"), same, "left_anti").select("r.*")
    return (
        matched.unionByName(left_alone, allowMissingColumns=True)
        .unionByName(right_alone, allowMissingColumns=True).select(*columns)
    )


def _same_key_types(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys of different types meet as text, apart from numbers among themselves and times among themselves."""
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    for k in keys:
        a, b = left.schema[k].dataType, right.schema[k].dataType
        if a == b:
            continue
        if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
            continue
        target = "timestamp_ntz" if isinstance(a, times) and isinstance(b, times) else "string"
        left = left.withColumn(k, F.col(k).cast(target))
        right = right.withColumn(k, F.col(k).cast(target))
    return left, right


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Bag union by name; missing columns become null, conflicting types meet as double or text."""
    types: dict[str, set] = {}
    for table in tables:
        for field in table.schema:
            types.setdefault(field.name, set()).add(field.dataType)

    def target(found: set) -> str | None:
        if len(found) == 1:
            return None
        return "double" if all(isinstance(t, T.NumericType) for t in found) else "string"

    def aligned(table: DataFrame) -> DataFrame:
        casts = {c: target(types[c]) for c in table.columns}
        return table.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if t})

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [aligned(t) for t in tables])


def merge_tables(tables: list[DataFrame]) -> DataFrame:
    """Outer-join the tables on their shared keys, left to right; union them when they share none.

    Names are normalised first, so that ``Date`` and ``date`` are one key. All joins but the last are stage tables.
    """
    if not tables:
        raise ValueError("no tables to merge")
    tables = [normalise_names(t) for t in tables]
    if len(tables) == 1:
        return tables[0]
    keys = merge_keys(tables)
    if not keys:
        return union_all(tables)
    merged = tables[0]
    for k, table in enumerate(tables[1:], 2):
        merged = outer_join(merged, table, keys)
        if k < len(tables):
            merged = staged(merged, "merged")  # a fold reads its left side three times, so it must not grow with the folds
    return merged


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys standing in more than one row: where an outer join would multiply rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def with_source_tag(df: DataFrame, tag: str) -> DataFrame:
    return df.withColumn(SOURCE_TAG, F.lit(tag))


def merge_sources(structured: DataFrame | None, unstructured: DataFrame | None) -> DataFrame:
    """Union tabular and document rows with a source tag; a missing side leaves the other unchanged."""
    if unstructured is None:
        return structured
    if structured is None:
        return unstructured
    return union_all([
        with_source_tag(structured, "structured"),
        with_source_tag(unstructured, "unstructured"),
    ])
