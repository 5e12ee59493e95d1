"""Rule-based report text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.functions.numbers import settled
from mediatally.operators.aggregate import OVERALL_RATIOS, kpi_overall, kpi_stats, summary
from mediatally.operators.anomalies import anomalies
from mediatally.operators.compare import period_comparison
from mediatally.operators.narrative import (
    CARDS, HIGHLIGHT_PADDING, ISSUE_PADDING, RECOMMENDATIONS, data_summary_lines, digest, digest_text, insights, kpi_cards,
    with_plain_totals,
)
from mediatally.operators.rank import top_performers
from mediatally.operators.roles import dimension_columns, metric_columns, time_axis
from mediatally.plans.report import kpi_tables, store
from mediatally.session import new_stage
from mediatally.sources.files import write_stage
from workload.aggregates import (
    CORR_SQL, _RATIO_SQL, _SIGNIFICANT_SQL, _TOTAL_SQL, _stats_sql, anomaly_sql, title_sql, top_sql,
)
from workload.cleaning import _SPLIT, _period_sql
from workload.registry import he, query, st, union_sql, with_sql
from workload.views import ALL_METRICS, BASE_METRICS, DERIVED_SQL, DIMENSIONS, PERF_SQL, derived, perf

KPI_SQL = "kpis as (" + union_sql(_TOTAL_SQL + _RATIO_SQL) + ")"

_SQL_FORMATS = {
    "count": "format('{:,}', value::bigint)",
    "percent": f"format('{{:.2f}}', {he('value', 2)}) || '%'",
    "money": f"'$' || format('{{:,.2f}}', {he('value', 2)})",
    "plain_money": f"'$' || format('{{:.2f}}', {he('value', 2)})",
    "multiplier": f"format('{{:.2f}}', {he('value', 2)}) || 'x'",
}


def _cards_sql(n: int) -> str:
    return with_sql(PERF_SQL, KPI_SQL) + union_sql([
        f"select {pos} as pos, '{label}' as label, {_SQL_FORMATS[style]} as text from kpis where kpi = '{kpi}'"
        for pos, (label, kpi, style) in enumerate(CARDS[:n], start=1)
    ])


@query("n01_kpi_cards", _cards_sql(9))
def _n01(spark: SparkSession, sf: str) -> DataFrame:
    return kpi_cards(kpi_overall(perf(spark, sf, BASE_METRICS)))


@query("n01_slide_cards", _cards_sql(6))
def _n01_slides(spark: SparkSession, sf: str) -> DataFrame:
    return kpi_cards(kpi_overall(perf(spark, sf, BASE_METRICS)), slides=True)


@query("n01_no_impressions", with_sql(PERF_SQL) + f"""
select 2 as pos, 'Total Clicks' as label, format('{{:,}}', sum(clicks)::bigint) as text from perf
union all select 5, 'Total Conversions', format('{{:,}}', sum(conversions)::bigint) from perf
union all select 6, 'Conversion Rate', format('{{:.2f}}', {he("sum(conversions) / sum(clicks) * 100", 2)}) || '%' from perf
""")
def _n01_clicks(spark: SparkSession, sf: str) -> DataFrame:
    # Clicks have no typed total without impressions; the plain one shows.
    df = perf(spark, sf, ["clicks", "conversions"])
    return kpi_cards(with_plain_totals(kpi_overall(df), kpi_stats(df)))


_FACTS_SQL = """
facts as (
  select count(*) as total_rows, min(ts)::varchar as start_at, max(ts)::varchar as end_at,
         floor(epoch(max(ts) - min(ts)) / 86400)::bigint as days
  from perf
)"""
_INPUTS = (PERF_SQL, DERIVED_SQL, KPI_SQL, _SPLIT, _period_sql(ALL_METRICS), anomaly_sql(ALL_METRICS, "derived"), top_sql(), _FACTS_SQL)


def _place(column: str = "metric") -> str:
    return f"list_position({ALL_METRICS}, {column})"


def _tables(spark: SparkSession, sf: str, names: tuple[str, ...]) -> tuple[dict[str, DataFrame], list[str]]:
    """The result tables the text is made of, and the metric columns.

    As in a report run, the derived table is handed over as a stage table, read once for each stage that the sections need.
    """
    folder = new_stage(spark, "results")
    df = spark.read.parquet(*write_stage({"derived": derived(spark, sf)}, folder))
    stored, _ = store(df, folder, list(names))
    tables = kpi_tables(df, stored=stored)
    return {name: tables[name] for name in names}, metric_columns(df)


_INSIGHTS_SQL = f"""
highlights as (
  select 1 as ord, 'Total impressions reached ' || format('{{:,}}', value::bigint) as text from kpis where kpi = 'total_impressions'
  union all select 2, 'Generated ' || format('{{:,}}', value::bigint) || ' total clicks' from kpis where kpi = 'total_clicks'
  union all select 3, 'Achieved ' || format('{{:,}}', value::bigint) || ' conversions' from kpis where kpi = 'total_conversions'
  union all select 3 + place, text from (
    select row_number() over (order by d_pos, m_pos) as place,
           'Top performer: ' || name || ' with ' || format('{{:,.2f}}', value) || ' ' || metric as text
    from toplists where rank = 1) where place <= 2
  union all select 100 + i, '{HIGHLIGHT_PADDING}' from range(5) t(i)
),
issues as (
  select {_place()} as ord, {title_sql("metric")} || ' decreased by ' || format('{{:.1f}}', {he("abs(change_pct)", 1)})
         || '% compared to previous period' as text
  from periods where change_pct < -10
  union all select 1000 + place, text from (
    select row_number() over (order by {_place()}) as place, percentage,
           'Detected ' || "count" || ' anomalies in ' || replace(metric, '_', ' ') || ' (' || format('{{:.1f}}', {he("percentage", 1)})
           || '% of data)' as text
    from flagged) where place <= 2 and percentage > 5
  union all select 10000 + i, '{ISSUE_PADDING}' from range(3) t(i)
)"""


def _kpi(name: str) -> str:
    return f"(select value from kpis where kpi = '{name}')"


@query("n02_insights", with_sql(*_INPUTS, _INSIGHTS_SQL) + f"""
select 'executive_summary' as section, 1 as pos, 'This report analyzes ' || format('{{:,}}', total_rows) || ' data records spanning '
    || start_at || ' to ' || end_at || '. The overall click-through rate is ' || format('{{:.2f}}', {he(_kpi("overall_ctr"), 2)})
    || '%. Total revenue generated is $' || format('{{:,.2f}}', {_kpi("total_revenue")})
    || '. Return on ad spend stands at ' || format('{{:.2f}}', {he(_kpi("overall_roas"), 2)}) || 'x.' as text
from facts
union all select 'key_highlights', pos, text from (select row_number() over (order by ord)::int as pos, text from highlights) where pos <= 5
union all select 'performance_issues', pos, text from (select row_number() over (order by ord)::int as pos, text from issues) where pos <= 3
union all select 'recommendations', pos, text from (values
  {", ".join(f"({i}, '{t}')" for i, t in enumerate(RECOMMENDATIONS, start=1))}) r(pos, text)
""")
def _n02(spark: SparkSession, sf: str) -> DataFrame:
    t, columns = _tables(spark, sf, ("kpi_overall", "top_performers", "period_comparison", "anomalies", "summary"))
    return insights(t["kpi_overall"], t["top_performers"], t["period_comparison"], t["anomalies"], t["summary"], DIMENSIONS, columns)


_PARTIAL_SQL = f"""
select 'recommendations' as section, pos, text from (values
  (1, 'Increase budget allocation to top-performing segments identified in this report'),
  (2, 'Investigate and address detected anomalies to improve data quality'),
  (3, 'Implement A/B testing for underperforming campaigns to optimize conversion rates')) r(pos, text)
union all select 'performance_issues', pos, text from (select row_number() over (order by ord)::int as pos, text from issues) where pos <= 3
union all select 'key_highlights', pos, text from (select row_number() over (order by ord)::int as pos, text from highlights) where pos <= 5
union all select 'executive_summary', 1, 'This report analyzes ' || format('{{:,}}', count(*)) || ' data records spanning '"""
_PADS_SQL = """
  union all select 100 + i, 'Data quality maintained throughout the reporting period' from range(5) t(i)
),
issues as (select i as ord, 'Consider implementing additional data validation checks' as text from range(3) t(i)"""


@query("n02_no_time", with_sql(PERF_SQL, f"""
leaders as (
  select 'campaign' as dimension, campaign as name, sum(revenue) as value from perf group by campaign
),
highlights as (
  select 4 as ord, 'Top performer: ' || name || ' with ' || format('{{:,.2f}}', {he("value", 2)}) || ' revenue' as text
  from (select name, {st("value", 2)} as value from leaders order by value desc, name limit 1) {_PADS_SQL}
)""") + _PARTIAL_SQL + f""" || 'N/A to N/A. Total revenue generated is $' || format('{{:,.2f}}', {st("sum(revenue)", 2)}) || '. ' from perf
""")
def _n02_no_time(spark: SparkSession, sf: str) -> DataFrame:
    return _partial(perf(spark, sf, ["campaign", "revenue"]))


@query("n02_no_dimension", with_sql(PERF_SQL, f"""
highlights as (
  select 2 as ord, 'Generated ' || format('{{:,}}', sum(clicks)::bigint) || ' total clicks' as text from perf {_PADS_SQL}
)""") + _PARTIAL_SQL + """ || min(ts)::varchar || ' to ' || max(ts)::varchar || '. ' from perf
""")
def _n02_no_dimension(spark: SparkSession, sf: str) -> DataFrame:
    # Clicks have no typed total here.
    return _partial(perf(spark, sf, ["ts", "clicks"]))


def _partial(df: DataFrame) -> DataFrame:
    """Insights from the sections that the columns give; no anomaly or drop stands out in these tables."""
    kpis = with_plain_totals(kpi_overall(df), kpi_stats(df))
    top = top_performers(df) if dimension_columns(df) else None
    comparison = period_comparison(df) if time_axis(df) else None
    return insights(kpis, top, comparison, anomalies(df), summary(df), dimension_columns(df), metric_columns(df))


_WHOLE = ["impressions", "clicks", "conversions", "visits", "unique_visitors"]
_MONEY = ["spend", "revenue"]
_STATS_SQL = "stats as (" + _stats_sql(ALL_METRICS, "derived") + ")"


def _two(expr: str) -> str:
    return f"format('{{:,.2f}}', {he(expr, 2)})"


_DIGEST_SQL = f"""
lines as (
  select 1 as section, {_place()} as place, o, '- ' || prefix || {title_sql("metric")} || ': ' || shown as text from (
    select metric, 1 as o, 'Total ' as prefix, case when metric in ({", ".join(f"'{m}'" for m in _WHOLE)})
             then format('{{:,}}', total::bigint) else {_two("total")} end as shown from stats
    union all select metric, 2, 'Avg ', {_two("avg")} from stats
    union all select metric, 3, 'Max ', {_two("max")} from stats
    union all select metric, 4, 'Min ', {_two("min")} from stats)
  union all
  select 1, 1000 + list_position({[r[0] for r in OVERALL_RATIOS]}, kpi), 0, '- ' || {title_sql("kpi")} || ': ' || {_two("value")}
  from kpis where starts_with(kpi, 'overall_')
  union all
  select 2, place, 0, '### Top ' || {title_sql("dimension")} || ' By ' || {title_sql("metric")} from ranked where rank = 1 and place <= 5
  union all
  select 2, place, rank, '- ' || name || ': ' || {_two("value")} from ranked where rank <= 3 and place <= 5
  union all
  select 3, {_place()}, 0, '- ' || {title_sql("metric")} || case when change_pct > 0 then ' increased by ' else ' decreased by ' end
         || format('{{:.1f}}', {he("abs(change_pct)", 1)}) || '%' from periods
  union all
  select 4, place, 0, text from (
    select row_number() over (order by {_place()}) as place, '- ' || {title_sql("metric")} || ': ' || "count" || ' anomalies detected ('
           || format('{{:.1f}}', {he("percentage", 1)}) || '% of data)' as text from flagged) where place <= 5
  union all
  select 5, rank, 0, '- ' || column1 || ' ↔ ' || column2 || ': ' || format('{{:.2f}}', {he("correlation", 2)}) || ' (' || strength || ')'
  from significant where rank <= 5
  union all select 6, 1, 0, '- Total Records: ' || format('{{:,}}', total_rows) from facts
  union all select 6, 2, 0, '- Date Range: ' || start_at || ' to ' || end_at from facts
  union all select 6, 3, 0, '- Total Days: ' || days from facts
),
numbered as (
  select section, row_number() over (partition by section order by place, o)::int as pos, text from lines
  union all select * from (values (1, 0, '## Key Metrics'), (2, 0, '## Top Performers'), (3, 0, '## Period-over-Period Changes'),
    (4, 0, '## Detected Anomalies'), (5, 0, '## Significant Correlations'), (6, 0, '## Data Summary'))
)"""
_RANKED_SQL = "ranked as (select *, dense_rank() over (order by d_pos, m_pos) as place from toplists)"
_DIGEST_INPUTS = (*_INPUTS, CORR_SQL, _SIGNIFICANT_SQL, _STATS_SQL, _RANKED_SQL, _DIGEST_SQL)


def _digest(spark: SparkSession, sf: str) -> DataFrame:
    t, columns = _tables(spark, sf, ("kpi_overall", "top_performers", "period_comparison", "anomalies", "summary", "correlations", "kpi_stats"))
    # Plain totals and means are settled as the other statistics queries show them.
    digits = {"total": 2, "avg": 4, "max": 4, "min": 4}
    stats = t["kpi_stats"].withColumns({c: settled(F.col(c), n) for c, n in digits.items()})
    return digest(
        stats, t["kpi_overall"], t["top_performers"], t["period_comparison"], t["anomalies"], t["correlations"], t["summary"],
        DIMENSIONS, columns,
    )


@query("n03_digest_lines", with_sql(*_DIGEST_INPUTS) + "select section, pos, text from numbered")
def _n03(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(spark, sf)


@query("n03_digest_text", with_sql(*_DIGEST_INPUTS) + """
select string_agg(case when starts_with(text, '#') and not (section = 1 and pos = 0) then chr(10) || text else text end, chr(10)
                  order by section, pos) as text
from numbered
""")
def _n03_text(spark: SparkSession, sf: str) -> DataFrame:
    return digest_text(_digest(spark, sf))


@query("n05_data_summary", with_sql(PERF_SQL, _FACTS_SQL) + """
select 1 as pos, 'Total Records: ' || format('{:,}', total_rows) as text from facts
union all select 2, 'Total Columns: 15'
union all select 3, 'Date Range: ' || start_at || ' to ' || end_at from facts
union all select 4, 'Total Days: ' || days from facts
union all select 5, 'Missing Values: 0.00%'
""")
def _n05(spark: SparkSession, sf: str) -> DataFrame:
    return data_summary_lines(summary(perf(spark, sf)))
