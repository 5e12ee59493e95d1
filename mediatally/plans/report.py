"""From a batch folder to every report table.

Each step is a function on DataFrames; stage tables are handed over as Parquet in a shared folder, so a
lost executor costs a task and not the lineage, and later steps read only the columns they need.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.operators.aggregate import (
    by_dimension, daily, daily_sums, dimension_sums, kpi_overall, kpi_overall_from, kpi_stats, summary, weekly,
)
from mediatally.operators.anomalies import anomalies, anomaly_values
from mediatally.operators.compare import period_comparison
from mediatally.operators.correlate import correlation_grid, pair_table, significant_pairs, weather_traffic
from mediatally.operators.derive import derive_metrics
from mediatally.operators.documents import document_summary, failed_documents
from mediatally.operators.facts import (
    anomalies_from, daily_from, days_with_flags, stats_from, summary_from, table_facts, weekly_from,
)
from mediatally.operators.fill import RANGES
from mediatally.operators.missing import fill_missing, missing_profile, missing_total
from mediatally.operators.narrative import data_summary_lines, digest, insights, kpi_cards, with_plain_totals
from mediatally.operators.parse import parse_time_columns
from mediatally.operators.rank import comparison_bars, first_top_list, top_performers, top_segments
from mediatally.operators.roles import (
    RANKED_METRICS, SEGMENT_METRICS, available, dimension_columns, metric_columns, segment_column, time_axis,
    time_named_columns,
)
from mediatally.operators.series import daily_series, trend_points
from mediatally.sources.batch import ingest_statistics, ingest_totals, mapping_frame, read_batch
from mediatally.sources.files import read_parquet, snapshot, write_stage


def transform(
    df: DataFrame, order_by: list[str] | None = None, scope: str | None = None, ranges: int | None = RANGES, layouts: list[str] | None = None
) -> DataFrame:
    """Parse times, fill what is missing, add the ratio metrics."""
    return derive_metrics(fill_missing(parse_time_columns(df, layouts=layouts), order_by, scope, ranges))


def transform_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(item, value): shapes, parsed time columns, cells filled, columns added."""
    parsed = parse_time_columns(before)
    held = after.select(*before.columns)
    added = [c for c in after.columns if c not in before.columns]
    counts = (
        missing_total(parsed).withColumnRenamed("missing", "missing_before")
        .crossJoin(missing_total(held).select(F.col("missing").alias("missing_after")))
    )
    items = [
        ("rows", F.col("rows").cast("string")),
        ("columns_before", F.lit(str(len(before.columns)))),
        ("columns_after", F.lit(str(len(after.columns)))),
        ("datetime_columns_parsed", F.lit(",".join(time_named_columns(before)))),
        ("missing_values_handled", (F.col("missing_before") - F.col("missing_after")).cast("string")),
        ("derived_metrics_added", F.lit(str(len(added)))),
        ("aggregations_created", F.lit(",".join(aggregation_names(after)))),
    ]
    rows = [F.struct(F.lit(name).alias("item"), value.alias("value")) for name, value in items]
    return counts.select(F.inline(F.array(*rows)))


def aggregation_names(df: DataFrame) -> list[str]:
    times = ["daily", "weekly"] if time_axis(df) else []
    return times + [f"by_{c}" for c in dimension_columns(df)]


class Stored(NamedTuple):
    """Stage tables that the sections of a report are cut from; None where the data does not give one."""

    daily: DataFrame | None = None
    by_dimension: DataFrame | None = None
    pairs: DataFrame | None = None
    facts: DataFrame | None = None
    days: DataFrame | None = None


# What each section is cut from; a section that is not named here reads the table.
NEEDS = {
    "kpi_stats": ("facts",), "kpi_overall": ("facts",), "summary": ("facts",), "anomalies": ("facts", "days"),
    "period_comparison": ("facts", "days"), "top_performers": ("by_dimension",), "correlations": ("pairs",),
    "weather_traffic": ("pairs",),
}


def store(df: DataFrame, folder: str, sections: list[str] | None = None) -> tuple[Stored, list[str]]:
    """The stage tables that the sections need (default: all there are) and their paths; each is made once.

    Every stage is one scan of the table. Given sections need no dimension's metrics that no list ranks; they are left out.
    """
    needed = {stage for s in (NEEDS if sections is None else sections) for stage in NEEDS.get(s, ())}
    ranked = available(df, RANKED_METRICS) if sections is not None else None
    paths, tables = [], {}

    def keep(name: str, table: DataFrame) -> None:
        paths.extend(write_stage({name: table}, folder))
        tables[name] = df.sparkSession.read.schema(table.schema).parquet(paths[-1])

    if "facts" in needed:
        keep("facts", table_facts(df))
    if "days" in needed and metric_columns(df):
        keep("days", days_with_flags(df, tables["facts"]))
        if time_axis(df):
            tables["daily"] = daily_from(tables["days"], metric_columns(df))
    if "by_dimension" in needed and dimension_columns(df) and (ranked or sections is None):
        keep("by_dimension", by_dimension(df, metrics=ranked))
    if "pairs" in needed and len(metric_columns(df)) > 1:
        keep("pairs", pair_table(df))
    return Stored(**tables), paths


def aggregations(df: DataFrame, stored: Stored = Stored()) -> dict[str, DataFrame]:
    """The stage aggregates by name: daily, weekly, by_<dimension>.

    With a stored ``by_dimension(df)`` all by_<dimension> tables are cut from that one small table instead of one
    scan each; a stored ``daily(df)`` is taken as it is, and weeks are summed from stored days.
    """
    tables: dict[str, DataFrame] = {}
    if time_axis(df):
        tables["daily"] = daily(df) if stored.daily is None else stored.daily
        tables["weekly"] = weekly(df) if stored.days is None else weekly_from(stored.days, metric_columns(df))
    for c in dimension_columns(df):
        rows = by_dimension(df, [c]) if stored.by_dimension is None else stored.by_dimension.where(F.col("dimension") == c)
        tables[f"by_{c}"] = rows.drop("dimension").withColumnRenamed("name", c)
    return tables


def kpi_tables(df: DataFrame, order_by: list[str] | None = None, stored: Stored = Stored()) -> dict[str, DataFrame]:
    """Every KPI section as a table; with stored tables (see NEEDS) only those of a given order read ``df``."""
    metrics = metric_columns(df)
    if stored.facts is None:
        tables = {"kpi_stats": kpi_stats(df), "kpi_overall": kpi_overall(df), "summary": summary(df)}
    else:
        stats = stats_from(stored.facts)
        tables = {"kpi_stats": stats, "kpi_overall": kpi_overall_from(stats, metrics), "summary": summary_from(stored.facts, df)}
    known = stored.facts is not None and stored.days is not None
    tables["anomalies"] = anomalies_from(stored.facts, stored.days, metrics) if known else anomalies(df)
    if dimension_columns(df) and available(df, RANKED_METRICS):
        totals = dimension_sums(stored.by_dimension, available(df, RANKED_METRICS)) if stored.by_dimension is not None else None
        tables["top_performers"] = top_performers(df, totals=totals)
    if time_axis(df):
        days = df if stored.daily is None else daily_sums(stored.daily)
        tables["period_comparison"] = period_comparison(days, metrics, time_axis(df) if stored.daily is None else "date")
    if len(metrics) > 1:
        tables["correlations"] = significant_pairs(df, stored=stored.pairs)
        tables["weather_traffic"] = weather_traffic(df, stored.pairs)
        tables["correlation_size"] = df.sparkSession.range(1).select(F.lit(len(metrics)).alias("total_variables"))
    if order_by:
        tables["anomaly_values"] = anomaly_values(df, order_by, facts=stored.facts)
    return tables


def chart_tables(df: DataFrame, kpis: dict[str, DataFrame], stored: Stored = Stored()) -> dict[str, DataFrame]:
    """The data of the five charts; a chart without its inputs is left out."""
    tables: dict[str, DataFrame] = {}
    if time_axis(df):
        tables["daily_performance"] = trend_points(daily_series(df if stored.daily is None else daily_sums(stored.daily)))
    if "top_performers" in kpis:
        tables["top_categories"] = first_top_list(kpis["top_performers"], dimension_columns(df))
    if segment := segment_column(df):
        metric = next(iter(available(df, SEGMENT_METRICS)), None)
        if stored.by_dimension is not None and metric and segment in dimension_columns(df):
            names = stored.by_dimension.where(F.col("dimension") == segment)
            tables["segmentation"] = top_segments(names.select(F.col("name").alias(segment), F.col(f"{metric}_sum").alias(metric)), segment, metric)
        else:
            tables["segmentation"] = top_segments(df)
    if "period_comparison" in kpis:
        tables["period_comparison_bars"] = comparison_bars(kpis["period_comparison"], metric_columns(df))
    if len(metric_columns(df)) > 1:
        tables["correlation_heatmap"] = correlation_grid(df, stored=stored.pairs)
    return tables


def text_tables(df: DataFrame, kpis: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cards, summary lines, insights and the KPI digest, from whatever sections there are."""
    totals = with_plain_totals(kpis["kpi_overall"], kpis["kpi_stats"])
    top, comparison, found = (kpis.get(k) for k in ("top_performers", "period_comparison", "anomalies"))
    dimensions, metrics = dimension_columns(df), metric_columns(df)
    return {
        "kpi_cards": kpi_cards(totals), "data_summary": data_summary_lines(kpis["summary"]),
        "insights": insights(totals, top, comparison, found, kpis["summary"], dimensions, metrics),
        "digest": digest(kpis["kpi_stats"], kpis["kpi_overall"], top, comparison, found, kpis.get("correlations"), kpis["summary"], dimensions, metrics),
    }


class Report(NamedTuple):
    table: DataFrame
    paths: list[str]


def run_report(
    spark: SparkSession, folder: str, out: str, order_by: list[str] | None = None, scope: str | None = None, ranges: int | None = RANGES
) -> Report:
    """Read a batch folder and write the cleaned table and every result table under ``out``.

    The cleaned table is read once for each stage table (facts, days, dimensions, pairs) and once for what is in
    row order; the other sections come from those.
    """
    batch = read_batch(spark, folder)
    paths = write_stage({"ingested": batch.table}, out)
    ingested = read_parquet(spark, paths[0])
    ingest = {"ingest_statistics": ingest_statistics(spark, batch), "ingest_totals": ingest_totals(batch._replace(table=ingested)), "missing_profile": missing_profile(ingested)}
    if batch.mapping:
        ingest["name_mapping"] = mapping_frame(spark, batch.mapping)
    if batch.texts is not None:
        ingest |= {"document_summary": document_summary(batch.texts), "failed_documents": failed_documents(batch.texts)}
    paths += write_stage(ingest, f"{out}/ingest")
    paths += write_stage({"transformed_data": transform(ingested, order_by, scope, ranges)}, out)
    df = read_parquet(spark, paths[-1])
    paths += write_stage({"transform_report": transform_report(ingested, df)}, out)
    if order_by:
        paths += write_stage({"snapshot": snapshot(df, order_by)}, out)
    stored, stage_paths = store(df, f"{out}/stages")
    paths += stage_paths
    paths += write_stage(aggregations(df, stored), f"{out}/aggregations")
    kpi_paths = write_stage(kpi_tables(df, order_by, stored), f"{out}/kpis")
    kpis = {p.rsplit("/", 1)[-1].removesuffix(".parquet"): spark.read.parquet(p) for p in kpi_paths}
    paths += kpi_paths
    paths += write_stage(chart_tables(df, kpis, stored), f"{out}/charts")
    paths += write_stage(text_tables(df, kpis), f"{out}/text")
    return Report(df, paths)
