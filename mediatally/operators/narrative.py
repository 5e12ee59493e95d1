"""Report text by rule: KPI cards, highlights and issues, the KPI digest, data summary lines.

Inputs are the small result tables of the other operators, so everything here runs on a few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediatally.functions.labels import (
    grouped_number, money, multiplier, percent, plain_money, plain_number, spaced, title_label,
)
from mediatally.operators.aggregate import OVERALL_RATIOS, WHOLE_TOTALS
from mediatally.operators.rank import list_order
from mediatally.operators.reshape import fan_out
from mediatally.operators.roles import RANKED_METRICS

# The KPI cards as (label, kpi, format), in display order; slides show the first six.
CARDS = [
    ("Total Impressions", "total_impressions", "count"),
    ("Total Clicks", "total_clicks", "count"),
    ("Overall CTR", "overall_ctr", "percent"),
    ("Total Spend", "total_spend", "money"),
    ("Total Conversions", "total_conversions", "count"),
    ("Conversion Rate", "overall_conversion_rate", "percent"),
    ("Cost Per Click", "overall_cpc", "plain_money"),
    ("Total Revenue", "total_revenue", "money"),
    ("ROAS", "overall_roas", "multiplier"),
]
SLIDE_CARDS = 6

# Report sentences that do not depend on the data.
HIGHLIGHT_PADDING = "Data quality maintained throughout the reporting period"
ISSUE_PADDING = "Consider implementing additional data validation checks"
RECOMMENDATIONS = [
    "Increase budget allocation to top-performing segments identified in this report",
    "Investigate and address detected anomalies to improve data quality",
    "Implement A/B testing for underperforming campaigns to optimize conversion rates",
]
HIGHLIGHTS = 5
ISSUES = 3
DROP_PCT = -10.0
ANOMALY_PCT = 5.0

_FORMATS = {
    "count": grouped_number, "percent": percent, "money": money, "plain_money": plain_money, "multiplier": multiplier,
}


def with_plain_totals(kpis: DataFrame, stats: DataFrame) -> DataFrame:
    """The KPIs, and the plain total of every metric that has no typed one (clicks without impressions); a few rows."""
    plain = stats.select(F.concat(F.lit("total_"), "metric").alias("kpi"), F.col("total").alias("value"))
    return kpis.unionByName(plain.join(F.broadcast(kpis.select("kpi")), "kpi", "left_anti"))


def kpi_cards(kpis: DataFrame, slides: bool = False) -> DataFrame:
    """(pos, label, text) of the cards whose KPI exists; pos is the card's fixed place."""
    cards = CARDS[:SLIDE_CARDS] if slides else CARDS
    known = {kpi: (pos, label, _FORMATS[style]) for pos, (label, kpi, style) in enumerate(cards, start=1)}

    def pick(make) -> Column:
        return F.coalesce(*[F.when(F.col("kpi") == kpi, make(*parts)) for kpi, parts in known.items()])

    return kpis.where(F.col("kpi").isin(list(known))).select(
        pick(lambda pos, label, fmt: F.lit(pos)).alias("pos"),
        pick(lambda pos, label, fmt: F.lit(label)).alias("label"),
        pick(lambda pos, label, fmt: fmt(F.col("value"))).alias("text"),
    )


def _one_row(kpis: DataFrame, names: list[str]) -> DataFrame:
    return kpis.agg(*[F.max(F.when(F.col("kpi") == k, F.col("value"))).alias(k) for k in names])


def _date_range(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("N/A"))


def summary_sentence(kpis: DataFrame, summary: DataFrame) -> DataFrame:
    """One (text) row: rows and date range, then CTR, revenue and ROAS when they exist."""
    names = ["overall_ctr", "total_revenue", "overall_roas"]
    both = summary.crossJoin(F.broadcast(_one_row(kpis, names)))

    def sentence(kpi: str, text: Column) -> Column:
        return F.when(F.col(kpi).isNotNull(), text).otherwise("")

    return both.select(F.concat(
        F.lit("This report analyzes "), grouped_number(F.col("total_rows")), F.lit(" data records spanning "),
        _date_range("date_range_start"), F.lit(" to "), _date_range("date_range_end"), F.lit(". "),
        sentence("overall_ctr", F.concat(
            F.lit("The overall click-through rate is "), percent(F.col("overall_ctr")), F.lit(". "))),
        sentence("total_revenue", F.concat(
            F.lit("Total revenue generated is "), money(F.col("total_revenue")), F.lit(". "))),
        sentence("overall_roas", F.concat(
            F.lit("Return on ad spend stands at "), multiplier(F.col("overall_roas")), F.lit("."))),
    ).alias("text"))


def _padded(candidates: DataFrame, padding: str, size: int, section: str) -> DataFrame:
    """The first ``size`` candidates in order, padded with a fixed line; candidates are a few rows."""
    pads = candidates.sparkSession.range(size).select((F.col("id") + 1_000_000).alias("ord"), F.lit(padding).alias("text"))
    lines = candidates.select(F.col("ord").cast("bigint"), "text").union(pads)
    ranked = lines.withColumn("pos", F.row_number().over(Window.orderBy("ord")))
    return ranked.where(F.col("pos") <= size).select(F.lit(section).alias("section"), "pos", "text")


def highlights(kpis: DataFrame, top: DataFrame | None, dimensions: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Five lines: totals, then the leaders of the first two top lists, padded."""
    number = grouped_number(F.col("value"))
    texts = {
        "total_impressions": (1, F.concat(F.lit("Total impressions reached "), number)),
        "total_clicks": (2, F.concat(F.lit("Generated "), number, F.lit(" total clicks"))),
        "total_conversions": (3, F.concat(F.lit("Achieved "), number, F.lit(" conversions"))),
    }
    lines = kpis.where(F.col("kpi").isin(list(texts))).select(
        F.coalesce(*[F.when(F.col("kpi") == k, F.lit(o)) for k, (o, _) in texts.items()]).alias("ord"),
        F.coalesce(*[F.when(F.col("kpi") == k, t) for k, (_, t) in texts.items()]).alias("text"),
    )
    if top is not None:
        place = list_order(dimensions, metrics or RANKED_METRICS)
        leaders = top.where(F.col("rank") == 1).withColumn("place", F.row_number().over(Window.orderBy(place)))
        lines = lines.union(leaders.where(F.col("place") <= 2).select(
            (F.col("place") + 3).alias("ord"),
            F.concat(F.lit("Top performer: "), F.col("name"), F.lit(" with "), grouped_number(F.col("value"), 2),
                     F.lit(" "), F.col("metric")).alias("text"),
        ))
    return _padded(lines, HIGHLIGHT_PADDING, HIGHLIGHTS, "key_highlights")


def _column_place(columns: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("metric"))


def issues(comparison: DataFrame | None, anomalies: DataFrame | None, columns: list[str], spark: SparkSession) -> DataFrame:
    """Three lines: drops beyond ten percent, then the first two anomalous metrics above five percent, padded."""
    lines = spark.createDataFrame([], "ord bigint, text string")
    if comparison is not None:
        lines = lines.union(comparison.where(F.col("change_pct") < DROP_PCT).select(
            _column_place(columns).alias("ord"),
            F.concat(title_label(F.col("metric")), F.lit(" decreased by "), percent(F.abs(F.col("change_pct")), 1),
                     F.lit(" compared to previous period")).alias("text"),
        ))
    if anomalies is not None:
        placed = anomalies.withColumn("place", F.row_number().over(Window.orderBy(_column_place(columns))))
        lines = lines.union(placed.where((F.col("place") <= 2) & (F.col("percentage") > ANOMALY_PCT)).select(
            (F.col("place") + 100_000).cast("bigint").alias("ord"),
            F.concat(F.lit("Detected "), F.col("count").cast("string"), F.lit(" anomalies in "), spaced(F.col("metric")),
                     F.lit(" ("), percent(F.col("percentage"), 1), F.lit(" of data)")).alias("text"),
        ))
    return _padded(lines, ISSUE_PADDING, ISSUES, "performance_issues")


def insights(
    kpis: DataFrame,
    top: DataFrame | None,
    comparison: DataFrame | None,
    anomalies: DataFrame | None,
    summary: DataFrame,
    dimensions: list[str],
    columns: list[str],
    metrics: list[str] | None = None,
) -> DataFrame:
    """(section, pos, text): summary sentence, five highlights, three issues, three recommendations.

    A table that the data does not give (no dimension, no time axis) is None; its lines are then padded.
    """
    first = summary_sentence(kpis, summary).select(F.lit("executive_summary").alias("section"), F.lit(1).alias("pos"), "text")
    advice = fan_out(summary, [], list(enumerate(RECOMMENDATIONS, start=1)), lambda item: {
        "section": F.lit("recommendations"), "pos": F.lit(item[0]), "text": F.lit(item[1]),
    })
    return reduce(DataFrame.unionByName, [
        first, highlights(kpis, top, dimensions, metrics), issues(comparison, anomalies, columns, summary.sparkSession), advice,
    ])


# Digest sections in order.
DIGEST_HEADINGS = [
    "## Key Metrics", "## Top Performers", "## Period-over-Period Changes", "## Detected Anomalies",
    "## Significant Correlations", "## Data Summary",
]


def digest(
    stats: DataFrame,
    kpis: DataFrame,
    top: DataFrame | None,
    comparison: DataFrame | None,
    anomalies: DataFrame | None,
    pairs: DataFrame | None,
    summary: DataFrame,
    dimensions: list[str],
    columns: list[str],
    metrics: list[str] | None = None,
) -> DataFrame:
    """(section, pos, text): the KPI digest, line by line; sections without data (None) have no heading."""
    spark = summary.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    top = none("dimension string, metric string, rank int, name string, value double") if top is None else top
    comparison = none("metric string, change_pct double") if comparison is None else comparison
    anomalies = none("metric string, count bigint, percentage double") if anomalies is None else anomalies
    pairs = none("rank int, column1 string, column2 string, correlation double, strength string") if pairs is None else pairs
    place = _column_place(columns)
    whole = [f"total_{m}" for m in WHOLE_TOTALS]
    label = lambda prefix: F.concat(F.lit("- "), F.lit(prefix), title_label(F.col("metric")), F.lit(": "))
    # Typed totals replace the plain total's value; whole ones print without decimals.
    typed = kpis.where(F.col("kpi").startswith("total_")).select(
        F.replace(F.col("kpi"), F.lit("total_"), F.lit("")).alias("metric"), F.col("value").alias("typed")
    )
    with_typed = stats.join(F.broadcast(typed), "metric", "left")
    is_whole = F.concat(F.lit("total_"), F.col("metric")).isin(whole) & F.col("typed").isNotNull()
    shown_total = F.when(is_whole, grouped_number(F.col("typed"))).otherwise(
        grouped_number(F.coalesce(F.col("typed"), F.col("total")), 2)
    )
    stat_lines = fan_out(with_typed.withColumn("place", place), ["place"], [
        (1, "Total ", shown_total),
        (2, "Avg ", grouped_number(F.col("avg"), 2)),
        (3, "Max ", grouped_number(F.col("max"), 2)),
        (4, "Min ", grouped_number(F.col("min"), 2)),
    ], lambda item: {"o": F.lit(item[0]), "text": F.concat(label(item[1]), item[2])})
    ratio_place = F.array_position(F.array(*[F.lit(r[0]) for r in OVERALL_RATIOS]), F.col("kpi"))
    ratio_lines = kpis.where(F.col("kpi").startswith("overall_")).select(
        (ratio_place + 1_000_000).alias("place"), F.lit(0).alias("o"),
        F.concat(F.lit("- "), title_label(F.col("kpi")), F.lit(": "), grouped_number(F.col("value"), 2)).alias("text"),
    )

    lists = F.dense_rank().over(Window.orderBy(list_order(dimensions, metrics or RANKED_METRICS)))
    listed = top.withColumn("place", lists).where("place <= 5 and rank <= 3")
    heading = F.concat(F.lit("### Top "), title_label(F.col("dimension")), F.lit(" By "), title_label(F.col("metric")))
    list_heads = listed.where("rank = 1").select("place", F.lit(0).alias("o"), heading.alias("text"))
    list_lines = listed.select(
        "place", F.col("rank").alias("o"),
        F.concat(F.lit("- "), F.col("name"), F.lit(": "), grouped_number(F.col("value"), 2)).alias("text"),
    )

    direction = F.when(F.col("change_pct") > 0, "increased").otherwise("decreased")
    change_lines = comparison.select(
        place.alias("place"), F.lit(0).alias("o"),
        F.concat(F.lit("- "), title_label(F.col("metric")), F.lit(" "), direction, F.lit(" by "),
                 percent(F.abs(F.col("change_pct")), 1)).alias("text"),
    )
    anomaly_lines = anomalies.select(
        F.row_number().over(Window.orderBy(place)).alias("place"), F.lit(0).alias("o"),
        F.concat(F.lit("- "), title_label(F.col("metric")), F.lit(": "), F.col("count").cast("string"),
                 F.lit(" anomalies detected ("), percent(F.col("percentage"), 1), F.lit(" of data)")).alias("text"),
    ).where("place <= 5")
    pair_lines = pairs.where("rank <= 5").select(
        F.col("rank").alias("place"), F.lit(0).alias("o"),
        F.concat(F.lit("- "), F.col("column1"), F.lit(" ↔ "), F.col("column2"), F.lit(": "),
                 plain_number(F.col("correlation"), 2), F.lit(" ("), F.col("strength"), F.lit(")")).alias("text"),
    )
    summary_lines = fan_out(summary, [], [
        F.concat(F.lit("- Total Records: "), grouped_number(F.col("total_rows"))),
        F.concat(F.lit("- Date Range: "), _date_range("date_range_start"), F.lit(" to "), _date_range("date_range_end")),
        F.concat(F.lit("- Total Days: "), F.coalesce(F.col("total_days").cast("string"), F.lit("N/A"))),
    ], lambda text: {"text": text})
    summary_lines = summary_lines.select(
        F.when(F.col("text").startswith("- Total R"), 1).when(F.col("text").startswith("- Date"), 2).otherwise(3).alias("place"),
        F.lit(0).alias("o"), "text",
    )

    sections = [
        stat_lines.unionByName(ratio_lines), list_heads.unionByName(list_lines), change_lines, anomaly_lines,
        pair_lines, summary_lines,
    ]
    lines = reduce(DataFrame.unionByName, [
        part.select(F.lit(i).alias("section"), F.col("place").cast("bigint"), F.col("o").cast("int"), "text")
        for i, part in enumerate(sections, start=1)
    ])
    heads = F.get(F.array(*[F.lit(h) for h in DIGEST_HEADINGS]), F.col("section") - 1)
    in_order = Window.partitionBy("section").orderBy("place", "o")
    numbered = lines.select("section", F.row_number().over(in_order).alias("pos"), "text")
    return numbered.union(numbered.where("pos = 1").select("section", F.lit(0), heads))


def digest_text(lines: DataFrame) -> DataFrame:
    """One (text) row: the digest as one string, a blank line before every heading but the first."""
    shown = F.when(
        F.col("text").startswith("#") & ~((F.col("section") == 1) & (F.col("pos") == 0)),
        F.concat(F.lit("\n"), F.col("text")),
    ).otherwise(F.col("text"))
    sorted_lines = F.array_sort(F.collect_list(F.struct("section", "pos", shown.alias("text"))))
    return lines.agg(F.array_join(F.transform(sorted_lines, lambda s: s["text"]), "\n").alias("text"))


def data_summary_lines(summary: DataFrame) -> DataFrame:
    """(pos, text): the five labelled values of the data summary."""
    texts = [
        F.concat(F.lit("Total Records: "), grouped_number(F.col("total_rows"))),
        F.concat(F.lit("Total Columns: "), F.col("total_columns").cast("string")),
        F.concat(F.lit("Date Range: "), _date_range("date_range_start"), F.lit(" to "), _date_range("date_range_end")),
        F.concat(F.lit("Total Days: "), F.coalesce(F.col("total_days").cast("string"), F.lit("N/A"))),
        F.concat(F.lit("Missing Values: "), percent(F.col("missing_percentage"))),
    ]
    return fan_out(summary, [], list(enumerate(texts, start=1)), lambda item: {"pos": F.lit(item[0]), "text": item[1]})
