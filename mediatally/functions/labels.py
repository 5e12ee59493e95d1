"""Display text: labels from column names, money, percent and multiplier formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediatally.functions.numbers import half_even


def title_label(name: Column) -> Column:
    """total_clicks -> Total Clicks."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def grouped_number(value: Column, digits: int = 0) -> Column:
    """1234567.5 -> 1,234,567.50 (half-even, thousands separators)."""
    return F.format_number(half_even(value.cast("double"), digits), digits)


def plain_number(value: Column, digits: int) -> Column:
    """1234.5 -> 1234.50 (half-even, no separators)."""
    return F.format_string(f"%.{digits}f", half_even(value.cast("double"), digits))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), grouped_number(value, 2))


def plain_money(value: Column) -> Column:
    return F.concat(F.lit("$"), plain_number(value, 2))


def percent(value: Column, digits: int = 2) -> Column:
    return F.concat(plain_number(value, digits), F.lit("%"))


def multiplier(value: Column) -> Column:
    return F.concat(plain_number(value, 2), F.lit("x"))
