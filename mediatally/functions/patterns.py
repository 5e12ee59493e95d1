"""Metrics and entities found in free text, as array columns over a text column.

All patterns ignore case and read the whole text. Every expression is row-local: no shuffle, no
Python. ``(?U)`` gives digits, spaces and word edges their Unicode meaning.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLAGS = "(?iU)"

# The patterns whose matches define each metric.
METRIC_PATTERNS = {
    "percentages": r"(\d+(?:\.\d+)?)\s*%",
    "dollar_amounts": r"\$\s*(\d+(?:,\d{3})*(?:\.\d{2})?)",
    "large_numbers": r"(\d+(?:\.\d+)?)\s*([KMB])\b",
    "impressions": r"(\d+(?:,\d{3})*)\s*(?:impressions?|views?)",
    "clicks": r"(\d+(?:,\d{3})*)\s*(?:clicks?)",
    "conversions": r"(\d+(?:,\d{3})*)\s*(?:conversions?)",
    "visitors": r"(\d+(?:,\d{3})*)\s*(?:visitors?|users?)",
    "ctr": r"(?:CTR|click[- ]?through[- ]?rate)[:\s]*(\d+(?:\.\d+)?)\s*%?",
    "dates": r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})",
}

# The patterns whose matches define each entity.
CAMPAIGN_PATTERNS = [
    r"(?:campaign|promo|promotion)[:\s]*[\"']?([^\"'.,\n]+)[\"']?",
    r"[\"']([^\"']+(?:campaign|promo|sale|offer))[\"']",
]
DATE_PATTERNS = [
    r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    r"\b(\d{4}[/-]\d{1,2}[/-]\d{1,2})\b",
    r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b",
]

# The region vocabulary, in its canonical spelling.
REGIONS = [
    "Northeast", "Southeast", "Midwest", "West", "Southwest", "Northwest",
    "North", "South", "East", "Central", "Pacific", "Atlantic",
    "USA", "US", "Europe", "Asia", "APAC", "EMEA", "LATAM",
]

# What a match of each date pattern starts with: looking at one character is cheaper than a word edge.
DATE_STARTS = [r"(?=\d)", r"(?=\d)", r"(?=[JFMASOND])"]

COUNTED = ["impressions", "clicks", "conversions", "visitors"]
NUMERIC_METRICS = ["large_numbers", *COUNTED]
TEXT_METRICS = ["percentages", "dollar_amounts", "ctr", "dates"]
ENTITIES = ["campaigns", "regions", "products", "dates", "companies"]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(group))


def _null_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _digit_table() -> tuple[str, str]:
    """Decimal digits of all scripts, and the ASCII digits they stand for."""
    others = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(others), "".join(str(unicodedata.decimal(c)) for c in others)


OTHER_DIGITS, ASCII_DIGITS = _digit_table()


def _number(hit: Column) -> Column:
    """A matched number as double; digits of other scripts count like ASCII ones."""
    plain = F.when(hit.rlike(r"[^\x00-\x7F]"), F.translate(hit, OTHER_DIGITS, ASCII_DIGITS)).otherwise(hit)
    return F.replace(plain, F.lit(","), F.lit("")).try_cast("double")


# Matches of each list before they are worked on. Callers that use a list more than once name these first, so that
# each pattern runs once a row.


def raw_metric(text: Column, metric: str) -> Column:
    return _found(text, METRIC_PATTERNS[metric], 0 if metric == "large_numbers" else 1)


def raw_campaigns(text: Column) -> Column:
    return F.concat(*[_found(text, pattern) for pattern in CAMPAIGN_PATTERNS])


def raw_dates(text: Column) -> Column:
    return F.concat(*[_found(text, start + pattern) for start, pattern in zip(DATE_STARTS, DATE_PATTERNS)])


def _counted(hits: Column) -> Column:
    return F.transform(hits, _number)


def _scaled(hits: Column) -> Column:
    scale = F.create_map(*[part for letter, factor in (("K", 1e3), ("M", 1e6), ("B", 1e9)) for part in (F.lit(letter), F.lit(factor))])
    return F.transform(hits, lambda hit: _number(F.regexp_extract(hit, r"(?U)^\d+(?:\.\d+)?", 0)) * scale[F.upper(F.right(hit, F.lit(1)))])


def _campaign_names(hits: Column) -> Column:
    trimmed = F.transform(hits, lambda hit: F.regexp_replace(hit, r"(?U)^\s+|\s+$", ""))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda hit: F.length(hit) > 2)))


def _date_names(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(hits))


def text_matches(text: Column, metric: str) -> Column:
    """Matches kept as text (percentages, dollar amounts, ctr, dates), in text order."""
    return _null_if_empty(raw_metric(text, metric))


def counted_matches(text: Column, metric: str) -> Column:
    """Whole numbers standing before the metric's word, thousands commas removed."""
    return _null_if_empty(_counted(raw_metric(text, metric)))


def scaled_matches(text: Column) -> Column:
    """Numbers with a K, M or B suffix, scaled to units."""
    return _null_if_empty(_scaled(raw_metric(text, "large_numbers")))


def campaigns(text: Column) -> Column:
    """Distinct campaign names, trimmed, longer than two characters, sorted."""
    return _campaign_names(raw_campaigns(text))


def regions(text: Column) -> Column:
    """Vocabulary words present as whole words, in canonical spelling, sorted.

    The text is cut into words once and met with the vocabulary, five times cheaper than an
    alternation with word edges tried at every character.
    """
    spelling = {word.lower(): word for word in sorted(REGIONS)}
    words = F.split(F.lower(F.upper(text)), r"(?U)\W+")
    present = F.array_intersect(F.array(*[F.lit(word) for word in spelling]), words)
    names = F.create_map(*[F.lit(part) for pair in spelling.items() for part in pair])
    return F.transform(present, lambda word: names[word])


def entity_dates(text: Column) -> Column:
    """Distinct dates standing as whole words, sorted."""
    return _date_names(raw_dates(text))


def no_entities() -> Column:
    """Products and companies are never filled by rules."""
    return F.array().cast("array<string>")


def raw_lists(text: Column) -> dict[str, Column]:
    """The matches of every list by name; a text without a digit has no metric and no date."""
    digit = text.rlike(r"(?U)\d")
    none = F.array().cast("array<string>")
    lists = {m: F.when(digit, raw_metric(text, m)).otherwise(none) for m in METRIC_PATTERNS}
    return lists | {
        "entity_campaigns": raw_campaigns(text), "entity_dates": F.when(digit, raw_dates(text)).otherwise(none),
        "entity_regions": regions(text),
    }


def metric_struct(raw: dict[str, Column]) -> Column:
    """All nine metric lists from their matches; a list without a match is null."""
    def values(metric: str) -> Column:
        made = _scaled(raw[metric]) if metric == "large_numbers" else _counted(raw[metric]) if metric in COUNTED else raw[metric]
        return F.when(F.size(raw[metric]) > 0, made)

    return F.struct(*[values(metric).alias(metric) for metric in METRIC_PATTERNS])


def entity_struct(raw: dict[str, Column]) -> Column:
    """All five entity lists from their matches; a list without a match is empty."""
    return F.struct(
        _campaign_names(raw["entity_campaigns"]).alias("campaigns"),
        raw["entity_regions"].alias("regions"),
        no_entities().alias("products"),
        _date_names(raw["entity_dates"]).alias("dates"),
        no_entities().alias("companies"),
    )
