"""Column roles decided from names and types: time, metric, text, dimension. No data pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Name parts that mark, or rule out, a time column.
TIME_WORDS = ["date", "timestamp", "created_at", "updated_at", "start_date", "end_date", "datetime"]
NOT_TIME_WORDS = [
    "spend", "revenue", "cost", "price", "amount", "clicks", "impressions", "conversions", "traffic",
    "visitors", "temp", "temperature", "rate", "ctr", "cpc", "cpm",
]

# Name parts that mark a grouping dimension.
DIMENSION_WORDS = [
    "region", "location", "category", "segment", "channel", "campaign", "source", "medium", "device",
    "platform", "country", "city",
]

# The priority orders used by rankings, series and segment shares.
RANKED_METRICS = [
    "impressions", "clicks", "conversions", "revenue", "spend", "visits", "foot_traffic", "ctr",
    "conversion_rate", "roas",
]
SERIES_METRICS = [
    "impressions", "clicks", "conversions", "spend", "revenue", "visits", "foot_traffic", "ctr",
    "conversion_rate",
]
SEGMENT_WORDS = [
    "region", "category", "segment", "channel", "source", "device", "platform", "campaign", "country",
]
SEGMENT_METRICS = ["revenue", "spend", "conversions", "clicks", "impressions", "visits"]

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def metric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans are neither metric nor dimension."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _TIME_TYPES)]


def time_axis(df: DataFrame) -> str | None:
    """The first time column in column order."""
    return next(iter(time_columns(df)), None)


def time_named_columns(df: DataFrame) -> list[str]:
    """Non-numeric columns whose name speaks of time and not of a metric."""
    numeric = set(metric_columns(df))

    def named(name: str) -> bool:
        low = name.lower()
        return any(w in low for w in TIME_WORDS) and not any(w in low for w in NOT_TIME_WORDS)

    return [name for name in df.columns if name not in numeric and named(name)]


def dimension_columns(df: DataFrame) -> list[str]:
    """Text columns whose name holds a dimension word."""
    return [c for c in text_columns(df) if any(w in c.lower() for w in DIMENSION_WORDS)]


def segment_column(df: DataFrame) -> str | None:
    """The text column matching the first segment word that matches any."""
    names = text_columns(df)
    return next((c for word in SEGMENT_WORDS for c in names if word in c.lower()), None)


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted names that exist, in the wanted order."""
    return [name for name in wanted if name in df.columns]


def column_roles(df: DataFrame) -> list[tuple[str, str]]:
    """(column, role) in column order; role is time, dimension, text, metric or other."""
    metrics, times = set(metric_columns(df)), set(time_columns(df))
    dimensions, texts = set(dimension_columns(df)), set(text_columns(df))

    def role(name: str) -> str:
        for members, label in ((times, "time"), (metrics, "metric"), (dimensions, "dimension"), (texts, "text")):
            if name in members:
                return label
        return "other"

    return [(name, role(name)) for name in df.columns]
