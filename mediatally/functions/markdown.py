"""Markdown to plain text on a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rewrites in the order they apply. Links run before images, so an image with an alt
# text keeps "!alt" and only images without one vanish.
REWRITES = [
    (r"(?md)^#+\s*", ""),
    (r"\*+([^*]+)\*+", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"```[\s\S]*?```", ""),
    (r"`([^`]+)`", "$1"),
]


def strip_markdown(text: Column) -> Column:
    for pattern, replacement in REWRITES:
        text = F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
