"""Casts that turn bad cells into nulls: time columns and the fixed numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatally.functions.numbers import nan_to_null
from mediatally.operators.roles import available, text_columns, time_named_columns

# Layouts tried after ISO dates and timestamps where nothing is known of a column; a cell keeps the first that fits.
DATE_LAYOUTS = [
    "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm",
    "M/d/yy", "d.M.yyyy", "d-MMM-yyyy", "yyyy/M/d H:mm", "M/d/yyyy h:mm a", "MMMM yyyy",
]

# Days and clocks that can be told apart by their looks; a layout is one of each.
DAYS = {
    r"\d{1,2}/\d{1,2}/\d{4}": "M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{2}": "M/d/yy", r"\d{1,2}-\d{1,2}-\d{4}": "M-d-yyyy",
    r"\d{1,2}-\d{1,2}-\d{2}": "M-d-yy", r"\d{1,2}\.\d{1,2}\.\d{4}": "d.M.yyyy", r"\d{1,2}\.\d{1,2}\.\d{2}": "d.M.yy",
    r"\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d", r"\d{4}\.\d{1,2}\.\d{1,2}": "yyyy.M.d", r"\d{8}": "yyyyMMdd",
    r"\d{1,2}-[A-Za-z]{3}-\d{4}": "d-MMM-yyyy", r"\d{1,2}-[A-Za-z]{3}-\d{2}": "d-MMM-yy",
    r"\d{1,2} [A-Za-z]{3} \d{4}": "d MMM yyyy", r"\d{1,2} [A-Za-z]{4,} \d{4}": "d MMMM yyyy",
    r"[A-Za-z]{3} \d{1,2}, \d{4}": "MMM d, yyyy", r"[A-Za-z]{4,} \d{1,2}, \d{4}": "MMMM d, yyyy",
    r"[A-Za-z]{3} \d{4}": "MMM yyyy", r"[A-Za-z]{4,} \d{4}": "MMMM yyyy",
}
CLOCKS = {
    r"$": "", r" \d{1,2}:\d{2}$": " H:mm", r" \d{1,2}:\d{2}:\d{2}$": " H:mm:ss", r" \d{1,2}:\d{2} ?[AaPp][Mm]$": " h:mm a",
    r" \d{1,2}:\d{2}:\d{2} ?[AaPp][Mm]$": " h:mm:ss a",
}
LOOKS = {day + clock: f"^{p}{q}" for p, day in DAYS.items() for q, clock in CLOCKS.items()}
LAYOUTS = list(LOOKS)
SWAPPED = {"M/d": "d/M", "M-d": "d-M", "d.M": "M.d"}  # the other reading of days whose order their looks leave open

# Columns forced to numbers.
NUMERIC_NAMES = [
    "clicks", "impressions", "conversions", "spend", "revenue", "visits", "foot_traffic", "unique_visitors",
    "engagements",
]


def to_time(text: Column, layouts: list[str] | None = None) -> Column:
    """Timestamp without zone from text; null when no layout fits. A time with an offset is put to UTC.

    Years of two digits are those from 1969 to 2068.
    """
    trimmed = F.trim(text)
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(trimmed.try_cast("timestamp")), F.lit("1970-01-01").cast("timestamp_ntz"))
    offset = trimmed.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$")
    iso = F.when(trimmed.rlike(r"^\d{4}-"), F.when(offset, instant).otherwise(trimmed.try_cast("timestamp_ntz")))
    return F.coalesce(iso, *[_by_layout(trimmed, layout) for layout in (DATE_LAYOUTS if layouts is None else layouts)])


def _by_layout(trimmed: Column, layout: str) -> Column:
    look = LOOKS.get(layout) or LOOKS.get(next((own + layout[3:] for own, other in SWAPPED.items() if layout.startswith(other)), ""))
    cell = trimmed
    if layout.endswith(" a"):
        trimmed = F.regexp_replace(trimmed, r"(\d)([AaPp][Mm])$", "$1 $2")
    found = F.try_to_timestamp(trimmed, F.lit(layout)).cast("timestamp_ntz")
    if "yy" in layout and "yyyy" not in layout:
        found = F.when(F.year(found) > 2068, found - F.expr("interval 100 years")).otherwise(found)
    return F.when(cell.rlike(look), found) if look else found


def _look(cell: Column) -> Column:
    """Number in LAYOUTS of the layout that a cell looks like; null for none. The first sign sends it to the patterns of its sort."""
    def first(numbered: list[tuple[int, str]], end: str, last: Column) -> Column:
        (n, pattern), *more = numbered
        chain = F.when(cell.rlike(f"{pattern}{end}"), n)
        for n, pattern in more:
            chain = chain.when(cell.rlike(f"{pattern}{end}"), n)
        return chain.otherwise(last)

    none = F.lit(None).cast("int")
    words = [(n, "^" + p) for n, p in enumerate(DAYS) if p.startswith("[")]
    years = [(n, "^" + p) for n, p in enumerate(DAYS) if p.startswith((r"\d{4}", r"\d{8}"))]
    others = [(n, "^" + p) for n, p in enumerate(DAYS) if p.startswith(r"\d{1,2}")]
    end = r"(?: \d|$)"
    day = F.when(cell.rlike(r"^\d{4}"), first(years, end, none)).when(cell.rlike(r"^\d"), first(others, end, none)).when(cell.rlike("^[A-Za-z]{3}"), first(words, end, none))
    clock = F.when(F.contains(cell, F.lit(":")), first([(n, r"\d" + p) for n, p in enumerate(CLOCKS) if n], "", F.lit(0))).otherwise(0)
    return day * len(CLOCKS) + clock


def _votes(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Per column the layouts that its cells look like, the most frequent first, from one aggregate.

    Whether days or months come first all cells of a column decide together: day first if a first number is beyond 12 and no
    second one is, between dots the other way round.
    """
    cell = F.col("cell")
    cells = df.unpivot([], columns, "column", "cell").select("column", F.trim("cell").alias("cell"))
    number = lambda group: F.regexp_extract(cell, r"^(\d{1,2})[/.-](\d{1,2})[/.-]", group)
    looks = cells.select("column", _look(cell).alias("layout"), number(1).alias("a"), number(2).alias("b"))
    top = lambda c: F.max(F.when(F.col(c) != "", F.col(c).cast("int"))).alias(c)  # a failing cast is slow, even a tried one
    rows = looks.groupBy("column", "layout").agg(F.count(F.lit(1)).alias("n"), top("a"), top("b")).collect()
    chosen = {}
    for c in columns:
        own = sorted((r for r in rows if r["column"] == c and r["layout"] is not None), key=lambda r: (-r["n"], r["layout"]))
        found = [LAYOUTS[r["layout"]] for r in own]
        for marks in (("M/d", "M-d"), ("d.M",)):
            held = [r for r, layout in zip(own, found) if layout.startswith(marks)]
            first, second = (max((r[k] or 0 for r in held), default=0) for k in ("a", "b"))
            if (first <= 12 < second) if marks == ("d.M",) else (second <= 12 < first):
                found = [SWAPPED[layout[:3]] + layout[3:] if layout.startswith(marks) else layout for layout in found]
        chosen[c] = found
    return chosen


def parse_time_columns(df: DataFrame, columns: list[str] | None = None, layouts: list[str] | None = None) -> DataFrame:
    """Parse the named (default: time-named) text columns; time-typed columns pass unchanged.

    Without ``layouts`` the cells of each column are looked through first, in one aggregate over the text columns, and only
    the layouts found there are tried. A stream has no such aggregate and tries DATE_LAYOUTS, months first.
    """
    wanted = time_named_columns(df) if columns is None else columns
    texts = [c for c in text_columns(df) if c in wanted]
    if layouts is not None or df.isStreaming or not texts:
        return df.withColumns({c: to_time(F.col(c), layouts) for c in texts})
    votes = _votes(df, texts)
    return df.withColumns({c: to_time(F.col(c), votes[c]) for c in texts})


def to_number(text: Column) -> Column:
    """Double from text, null when it is no number, as NaN is; the JVM's 1d and 1f spellings are no numbers."""
    trimmed = F.trim(text)
    return nan_to_null(F.when(~trimmed.rlike(r"[0-9.][dDfF]$"), trimmed.try_cast("double")))


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Force the fixed metric names to double; cells that are no number become null."""
    wanted = available(df, NUMERIC_NAMES)
    texts = set(text_columns(df))
    return df.withColumns({c: to_number(F.col(c)) for c in wanted if c in texts})
