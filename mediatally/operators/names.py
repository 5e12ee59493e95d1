"""Column naming: headers become snake_case. Works on the schema only, no data pass."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


# The rewrites of a lower-case header, in order.
NAME_RULES = [(r"[\s\-.]+", "_"), (r"[^a-z0-9_]", ""), (r"_+", "_")]


def snake_case(header: str) -> str:
    name = header.strip().lower()
    for pattern, replacement in NAME_RULES:
        name = re.sub(pattern, replacement, name)
    return name.strip("_")


def normalised_names(headers: list[str]) -> list[str]:
    """Snake_case names in order; a repeated or empty name gets a numeric suffix.

    Spark cannot refer to one of two equal column names, so collisions are told apart here.
    """
    taken: set[str] = set()
    names = []
    for header in headers:
        base = snake_case(header) or "column"
        name, suffix = base, 2
        while name in taken:
            name, suffix = f"{base}_{suffix}", suffix + 1
        taken.add(name)
        names.append(name)
    return names


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normalised_names(df.columns))


def name_mapping(df: DataFrame) -> list[tuple[str, str]]:
    """(old name, new name) in column order."""
    return list(zip(df.columns, normalised_names(df.columns)))
