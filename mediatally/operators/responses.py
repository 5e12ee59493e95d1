"""Narrative responses split into their sections, inside each row: no shuffle.

A header is any line naming a section, whatever else it says. Bullets lose their marks; the summary also
keeps plain lines. A section counts only when its expected successor follows, or when it is the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section, the words that head it (first match wins), the section expected after it.
SECTIONS = [
    ("executive_summary", ["executive summary"], "key_highlights"),
    ("key_highlights", ["key highlight", "highlights"], "performance_issues"),
    ("performance_issues", ["performance issue", "issues", "concerns"], "recommendations"),
    ("recommendations", ["recommendation", "action"], None),
]
# What a bullet line starts with, and the marks taken off it.
BULLET = r"^[-•*1-5]"
BULLET_MARKS = r"^[-•* 0-9.)]+"

_EDGES = r"(?U)^\s+|\s+$"


def _header(line: Column) -> Column:
    """The section a line heads, else null."""
    low = F.lower(line)

    def names(words: list[str]) -> Column:
        found = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains(low, F.lit(word))
        return found

    return F.coalesce(*[F.when(names(words), F.lit(section)) for section, words, _ in SECTIONS])


def _item(line: Column, section: Column) -> Column:
    """The text a line adds to its section, else null."""
    bullet = line.rlike(BULLET)
    cleaned = F.regexp_replace(line, BULLET_MARKS, "")
    return F.when((line != "") & ~line.startswith("#"), F.when(bullet, F.when(cleaned != "", cleaned)).otherwise(
        F.when(section == "executive_summary", line)
    ))


def _blocks(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids..., __blocks): array of (section, next section, items), one per header line.

    Lines and headers are columns of their own, so that they are worked out once per row and not once per
    block.
    """
    lines, heads = F.col("__lines"), F.col("__heads")
    split = df.select(*ids, F.transform(F.split(F.col(text), "\n"), lambda l: F.regexp_replace(l, _EDGES, "")).alias("__lines"))
    numbered = F.transform(lines, lambda l, i: F.struct(i.alias("at"), _header(l).alias("section")))
    headed = split.withColumn("__heads", F.filter(numbered, lambda e: e["section"].isNotNull()))

    def block(head: Column, k: Column) -> Column:
        following = F.get(heads, k + 1)
        size = F.coalesce(following["at"], F.size(lines)) - head["at"] - 1
        body = F.slice(lines, head["at"] + 2, size)
        items = F.filter(F.transform(body, lambda l: _item(l, head["section"])), lambda t: t.isNotNull())
        return F.struct(head["section"].alias("section"), following["section"].alias("next"), items.alias("items"))

    return headed.select(*ids, F.transform(heads, block).alias("__blocks"))


def _kept(section: str, successor: str | None) -> Column:
    """Items of the last block of a section that counts."""
    def counts(b: Column) -> Column:
        last = b["next"].isNull()
        follows = last | (b["next"] == successor) if successor else last
        return (b["section"] == section) & (F.size(b["items"]) > 0) & follows

    found = F.filter(F.col("__blocks"), counts)
    return F.get(found, F.size(found) - 1)["items"]


def _labelled(items: Column, section: str) -> Column:
    return F.transform(
        items, lambda text, i: F.struct(F.lit(section).alias("section"), (i + 1).alias("pos"), text.alias("text"))
    )


def parse_responses(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids..., section, pos, text): one row per kept item; the summary is one row of joined lines."""
    blocks = _blocks(df, ids, text)
    parts = []
    for section, _, successor in SECTIONS:
        items = _kept(section, successor)
        if section == "executive_summary":
            items = F.when(items.isNotNull(), F.array(F.array_join(items, " ")))
        parts.append(_labelled(F.coalesce(items, F.array().cast("array<string>")), section))
    return blocks.select(*ids, F.inline(F.concat(*parts)))
