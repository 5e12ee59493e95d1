"""Row-level ratio metrics, one table of definitions, one projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediatally.functions.numbers import half_even, ratio
from mediatally.operators.parse import coerce_numeric


class Ratio(NamedTuple):
    name: str
    numerator: str
    denominator: str
    factor: float
    digits: int


# The derived metrics in the order they are added.
RATIOS = [
    Ratio("ctr", "clicks", "impressions", 100.0, 4),
    Ratio("cpc", "spend", "clicks", 1.0, 4),
    Ratio("cpm", "spend", "impressions", 1000.0, 4),
    Ratio("conversion_rate", "conversions", "clicks", 100.0, 4),
    Ratio("cpa", "spend", "conversions", 1.0, 4),
    Ratio("roas", "revenue", "spend", 1.0, 4),
    Ratio("engagement_rate", "engagements", "impressions", 100.0, 4),
    Ratio("pages_per_visit", "visits", "unique_visitors", 1.0, 2),
]


def derivable(df: DataFrame) -> list[Ratio]:
    """Ratios whose two inputs both exist."""
    return [r for r in RATIOS if r.numerator in df.columns and r.denominator in df.columns]


def derive_metrics(df: DataFrame) -> DataFrame:
    """Add every ratio whose inputs exist; a zero denominator gives null."""
    df = coerce_numeric(df)
    return df.withColumns({
        r.name: half_even(ratio(F.col(r.numerator), F.col(r.denominator), r.factor), r.digits)
        for r in derivable(df)
    })
