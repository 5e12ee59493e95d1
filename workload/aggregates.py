"""Aggregate, comparison, anomaly, correlation, ranking and series queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediatally.operators.aggregate import (
    by_dimension, daily, distinct_counts, exact_totals, kpi_overall, kpi_stats, overall_ratios, summary, typed_totals, value_counts,
    weekly,
)
from mediatally.operators.anomalies import anomalies, anomaly_values
from mediatally.operators.compare import period_comparison
from mediatally.operators.correlate import (
    correlation_grid, correlation_pairs, significant_pairs, variances, weather_traffic, widest_metrics,
)
from mediatally.operators.derive import derive_metrics
from mediatally.operators.fill import fill_times
from mediatally.operators.rank import comparison_bars, first_top_list, top_performers, top_segments
from mediatally.operators.roles import RANKED_METRICS
from mediatally.operators.series import daily_series, trend_lines, trend_points
from workload.cleaning import _SPLIT, _period_sql
from workload.registry import he, query, shown, st, union_sql, with_sql
from workload.views import (
    ALL_METRICS, BASE_METRICS, DERIVED_SQL, DIMENSIONS, ORDER, PERF_SQL, ROUGH_METRICS, ROUGH_SQL,
    derived, perf, rough, table,
)

PERF = with_sql(PERF_SQL)
DERIVED = with_sql(PERF_SQL, DERIVED_SQL)
ROUGH = with_sql(PERF_SQL, ROUGH_SQL)


def _sum_mean_sql(metrics: list[str]) -> str:
    return ", ".join(
        f"{st(f'coalesce(sum({m}), 0)::double', 2)} as {m}_sum, {st(f'avg({m}::double)', 4)} as {m}_mean" for m in metrics
    )


def _sum_mean_shown(df: DataFrame, metrics: list[str]) -> DataFrame:
    sums = tuple(f"{m}_sum" for m in metrics)
    means = tuple(f"{m}_mean" for m in metrics)
    return shown(shown(df, 2, keep=means), 4, keep=sums)


# Time and dimension aggregates ------------------------------------------------------------------

@query("a01_daily", DERIVED + f"""
select strftime(ts, '%Y-%m-%d') as "date", {_sum_mean_sql(ALL_METRICS)} from derived group by 1
""")
def _a01(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, ["ts", *BASE_METRICS])
    return _sum_mean_shown(daily(df), ALL_METRICS)


@query("a01_daily_with_holes", ROUGH + f"""
select strftime(ts, '%Y-%m-%d') as "date", {_sum_mean_sql(ROUGH_METRICS)} from rough where ts is not null group by 1
""")
def _a01_holes(spark: SparkSession, sf: str) -> DataFrame:
    return _sum_mean_shown(daily(rough(spark, sf), ROUGH_METRICS), ROUGH_METRICS)


@query("a02_weekly", PERF + f"""
select year(ts)::int as "year", week(ts)::int as week, {_sum_mean_sql(BASE_METRICS)} from perf group by 1, 2
""")
def _a02(spark: SparkSession, sf: str) -> DataFrame:
    return _sum_mean_shown(weekly(perf(spark, sf, ["ts", *BASE_METRICS])), BASE_METRICS)


@query("a02_weekly_iso_year", PERF + f"""
select isoyear(ts)::int as "year", week(ts)::int as week, {_sum_mean_sql(["spend", "revenue"])} from perf group by 1, 2
""")
def _a02_iso(spark: SparkSession, sf: str) -> DataFrame:
    df = perf(spark, sf, ["ts", "spend", "revenue"])
    return _sum_mean_shown(weekly(df, iso_year=True), ["spend", "revenue"])


_DIM_METRICS = ["impressions", "clicks", "spend", "revenue", "ctr", "cpc"]
_DIM_SQL = ", ".join(
    f"{st(f'coalesce(sum({m}), 0)::double', 2)} as {m}_sum, {st(f'avg({m}::double)', 4)} as {m}_mean, count({m}) as {m}_count"
    for m in _DIM_METRICS
)


@query("a03_by_dimension", DERIVED + union_sql([
    f"select '{d}' as dimension, {d} as name, {_DIM_SQL} from derived group by {d}" for d in DIMENSIONS
]))
def _a03(spark: SparkSession, sf: str) -> DataFrame:
    df = derive_metrics(perf(spark, sf, [*DIMENSIONS, "impressions", "clicks", "spend", "revenue"]))
    return _sum_mean_shown(by_dimension(df, DIMENSIONS, _DIM_METRICS), _DIM_METRICS)


def _stats_sql(metrics: list[str], source: str) -> str:
    return union_sql([
        f"select '{m}' as metric, {st(f'coalesce(sum({m}), 0)::double', 2)} as total, {st(f'avg({m}::double)', 4)} as avg, "
        f"{he(f'max({m})::double', 4)} as max, {he(f'min({m})::double', 4)} as min from {source}"
        for m in metrics
    ])


@query("a04_metric_stats", DERIVED + _stats_sql(ALL_METRICS, "derived"))
def _a04(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, BASE_METRICS)
    return shown(shown(kpi_stats(df), 2, keep=("avg", "max", "min")), 4, keep=("total", "max", "min"))


@query("a04_metric_stats_with_holes", ROUGH + _stats_sql(ROUGH_METRICS, "rough"))
def _a04_holes(spark: SparkSession, sf: str) -> DataFrame:
    df = rough(spark, sf).select(*ROUGH_METRICS)
    return shown(shown(kpi_stats(df), 2, keep=("avg", "max", "min")), 4, keep=("total", "max", "min"))


_RATIO_SQL = [
    f"select '{name}' as kpi, case when sum({den}) > 0 then {st(f'sum({num})::double / sum({den})::double * {factor}::double', 4)} else 0 end as value from perf"
    for name, num, den, factor in [
        ("overall_ctr", "clicks", "impressions", 100.0), ("overall_cpc", "spend", "clicks", 1.0),
        ("overall_cpm", "spend", "impressions", 1000.0), ("overall_conversion_rate", "conversions", "clicks", 100.0),
        ("overall_cpa", "spend", "conversions", 1.0), ("overall_roas", "revenue", "spend", 1.0),
    ]
]
_TOTAL_SQL = [
    f"select 'total_{m}' as kpi, trunc(sum({m})::double) as value from perf"
    for m in ["impressions", "clicks", "conversions", "visits", "unique_visitors"]
] + [f"select 'total_{m}' as kpi, {st(f'sum({m})', 2)} as value from perf" for m in ["spend", "revenue"]]


@query("a05_overall_ratios", PERF + union_sql(_RATIO_SQL))
def _a05(spark: SparkSession, sf: str) -> DataFrame:
    return overall_ratios(perf(spark, sf, BASE_METRICS))


@query("a06_typed_totals", PERF + union_sql(_TOTAL_SQL))
def _a06(spark: SparkSession, sf: str) -> DataFrame:
    return typed_totals(perf(spark, sf, BASE_METRICS))


@query("a06_large_totals", """
select 'impressions' as metric, sum(9007199254740993 + event_id::hugeint)::decimal(38, 2)::varchar as total from events
union all select 'clicks', sum(event_id)::decimal(38, 2)::varchar from events
union all select 'spend', sum(value::decimal(28, 2))::decimal(38, 2)::varchar from events
""")
def _a06_large(spark: SparkSession, sf: str) -> DataFrame:
    # Whole numbers above 2 ** 53, which a double cannot hold.
    events = table(spark, sf, "events").select(
        (F.col("event_id") + F.lit(9007199254740993)).alias("impressions"), F.col("event_id").alias("clicks"), F.col("value").alias("spend"),
    )
    return exact_totals(events).withColumn("total", F.col("total").cast("string"))


@query("a06_kpi_overall", PERF + union_sql(_TOTAL_SQL + _RATIO_SQL))
def _a06_all(spark: SparkSession, sf: str) -> DataFrame:
    return kpi_overall(perf(spark, sf, BASE_METRICS))


SUMMARY_COLUMNS = ["ts", "campaign", "region", "clicks", "spend", "revenue", "foot_traffic", "segment_note"]
SUMMARY_SQL = f"""
facts as (
  select count(*) as total_rows, {len(SUMMARY_COLUMNS)} as total_columns, 4 as numeric_columns, 3 as categorical_columns,
         1 as datetime_columns, ({" + ".join(f"count(*) - count({c})" for c in SUMMARY_COLUMNS)})::bigint as missing_values,
         min(ts) as first_at, max(ts) as last_at
  from rough
)"""


@query("a07_summary", with_sql(PERF_SQL, ROUGH_SQL, SUMMARY_SQL) + f"""
select total_rows, total_columns, numeric_columns, categorical_columns, datetime_columns, missing_values,
       {st("missing_values::double / (total_rows * total_columns) * 100", 2)} as missing_percentage,
       first_at::varchar as date_range_start, last_at::varchar as date_range_end,
       floor(epoch(last_at - first_at) / 86400)::bigint as total_days
from facts
""")
def _a07(spark: SparkSession, sf: str) -> DataFrame:
    return shown(summary(rough(spark, sf).select(*SUMMARY_COLUMNS)), 2)


@query("a08_period_comparison", with_sql(PERF_SQL, DERIVED_SQL, _SPLIT, _period_sql(ALL_METRICS)) + "select * from periods")
def _a08(spark: SparkSession, sf: str) -> DataFrame:
    return shown(period_comparison(derived(spark, sf, ["ts", *BASE_METRICS])), 2)


def anomaly_sql(metrics: list[str], source: str, threshold: float = 2.0) -> str:
    stats = ", ".join(
        f"count({m}) as n_{m}, avg({m}::double) as mean_{m}, stddev_pop({m}::double) as sd_{m}, stddev_samp({m}::double) as ssd_{m}"
        for m in metrics
    )
    rows = union_sql([
        f"select '{m}' as metric, count(*) filter (abs(({m} - mean_{m}) / nullif(sd_{m}, 0)) > {threshold}) as \"count\", "
        f"any_value(n_{m}) as n, any_value(mean_{m}) as mean, any_value(ssd_{m}) as std from {source}, zstats"
        for m in metrics
    ])
    return f"""
zstats as (select {stats} from {source}),
flagged as (
  select metric, "count", {st('"count"::double / n * 100', 2)} as percentage, {st("mean", 2)} as mean, {st("std", 2)} as std
  from ({rows}) where "count" > 0 and n >= 3
)"""


@query("a09_anomalies", with_sql(PERF_SQL, DERIVED_SQL, anomaly_sql(ALL_METRICS, "derived")) + "select * from flagged")
def _a09(spark: SparkSession, sf: str) -> DataFrame:
    return anomalies(derived(spark, sf, BASE_METRICS))


@query("a09_anomalies_with_holes", with_sql(PERF_SQL, ROUGH_SQL, anomaly_sql(ROUGH_METRICS, "rough", 1.5)) + "select * from flagged")
def _a09_holes(spark: SparkSession, sf: str) -> DataFrame:
    return anomalies(rough(spark, sf), ROUGH_METRICS, threshold=1.5)


_PAIRS = list(combinations(ALL_METRICS, 2))


def _corr_sql(pairs: list[tuple[str, str]], source: str) -> str:
    return union_sql([
        f"select {i} as ord, '{a}' as column1, '{b}' as column2, "
        f"covar_pop(case when {b} is not null then {a}::double end, case when {a} is not null then {b}::double end) "
        f"/ nullif(stddev_pop(case when {b} is not null then {a}::double end) * stddev_pop(case when {a} is not null then {b}::double end), 0) as r "
        f"from {source}"
        for i, (a, b) in enumerate(pairs)
    ])


CORR_SQL = f"corr as ({_corr_sql(_PAIRS, 'derived')})"


@query("a10_correlation_pairs", with_sql(PERF_SQL, DERIVED_SQL, CORR_SQL) + f"""
select column1, column2, {st("r", 4)} as correlation from corr
""")
def _a10(spark: SparkSession, sf: str) -> DataFrame:
    pairs = correlation_pairs(derived(spark, sf, BASE_METRICS)).where("i < j")
    return shown(pairs.select("column1", "column2", "correlation"), 4)


_SIGNIFICANT_SQL = f"""
significant as (
  select column1, column2, correlation, strength, rank from (
    select *, row_number() over (order by abs(correlation) desc, ord)::int as rank
    from (select ord, column1, column2, {st("r", 4)} as correlation,
                 case when abs(r) > 0.7 then 'strong' else 'moderate' end as strength
          from corr where abs(r) > 0.5))
  where rank <= 10
)"""


@query("a11_significant_pairs", with_sql(PERF_SQL, DERIVED_SQL, CORR_SQL, _SIGNIFICANT_SQL) + "select * from significant")
def _a11(spark: SparkSession, sf: str) -> DataFrame:
    return significant_pairs(derived(spark, sf, BASE_METRICS))


_TRAFFIC_PAIRS = [("weather_temp", t) for t in ["visits", "unique_visitors", "pages_per_visit"]]


@query("a12_weather_traffic", with_sql(PERF_SQL, DERIVED_SQL, f"corr as ({_corr_sql(_TRAFFIC_PAIRS, 'derived')})") + f"""
select column1, column2, {st("r", 4)} as correlation from corr where r is not null
""")
def _a12(spark: SparkSession, sf: str) -> DataFrame:
    return weather_traffic(derived(spark, sf, ["weather_temp", "visits", "unique_visitors"]))


@query("a13_distinct_counts", PERF + union_sql([
    f"select '{d}' as dimension, count(distinct {d}) as names from perf" for d in DIMENSIONS
]))
def _a13(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_counts(perf(spark, sf, DIMENSIONS), DIMENSIONS)


@query("a14_value_counts", PERF + """
select campaign as name, count(*) as "rows" from perf group by 1 order by 2 desc, 1 limit 8
""")
def _a14(spark: SparkSession, sf: str) -> DataFrame:
    return value_counts(perf(spark, sf, ["campaign"]), "campaign")


_VARIANCE_SQL = "spread as (" + union_sql([
    f"select {i} as ord, '{m}' as metric, var_samp({m}::double) as variance from derived" for i, m in enumerate(ALL_METRICS)
]) + ")"
_WIDEST_SQL = """
widest as (
  select metric, variance, rank from (
    select *, row_number() over (order by variance desc, ord)::int as rank from spread where variance is not null)
  where rank <= 10
)"""


@query("a15_variances", with_sql(PERF_SQL, DERIVED_SQL, _VARIANCE_SQL) + f"select metric, {st('variance', 2)} as variance from spread")
def _a15_all(spark: SparkSession, sf: str) -> DataFrame:
    return shown(variances(derived(spark, sf, BASE_METRICS)), 2)


@query("a15_widest_metrics", with_sql(PERF_SQL, DERIVED_SQL, _VARIANCE_SQL, _WIDEST_SQL) + "select metric, rank from widest")
def _a15(spark: SparkSession, sf: str) -> DataFrame:
    return widest_metrics(derived(spark, sf, BASE_METRICS)).select("metric", "rank")


_SERIES = ["impressions", "clicks", "conversions", "spend"]
_SERIES_SQL = "series as (select cast(ts as date) as day, " + ", ".join(
    f"sum({m})::double as {m}" for m in _SERIES
) + " from perf group by 1)"
_TREND_SQL = "trend as (" + union_sql([
    f"select '{m}' as metric, regr_slope({m}, i) as slope, regr_intercept({m}, i) as intercept, count(*) as points "
    "from (select *, (row_number() over (order by day) - 1)::double as i from series) having count(*) > 2"
    for m in _SERIES
]) + ")"


@query("a16_trend_lines", with_sql(PERF_SQL, _SERIES_SQL, _TREND_SQL) + f"""
select metric, {st("slope", 4)} as slope, {st("intercept", 2)} as intercept, points from trend
""")
def _a16(spark: SparkSession, sf: str) -> DataFrame:
    lines = trend_lines(daily_series(perf(spark, sf, ["ts", *_SERIES])))
    return shown(shown(lines, 4, keep=("intercept",)), 2, keep=("slope",))


@query("a16_trend_points", with_sql(PERF_SQL, _SERIES_SQL, _TREND_SQL) + union_sql([
    f"""select s.day::varchar as "date", '{m}' as metric, {st(f"s.{m}", 2)} as value, {st("slope * i + intercept", 2)} as trend
from (select *, (row_number() over (order by day) - 1)::double as i from series) s, trend where trend.metric = '{m}'"""
    for m in _SERIES
]))
def _a16_points(spark: SparkSession, sf: str) -> DataFrame:
    return shown(trend_points(daily_series(perf(spark, sf, ["ts", *_SERIES]))), 2)


# Rankings and chart tables ----------------------------------------------------------------------

_TOP_METRICS = [m for m in RANKED_METRICS if m in ALL_METRICS]


def top_sql(dimensions: list[str] = DIMENSIONS, metrics: list[str] = _TOP_METRICS, n: int = 5) -> str:
    lists = union_sql([
        f"select '{d}' as dimension, {i} as d_pos, '{m}' as metric, {j} as m_pos, {d} as name, coalesce(sum({m}), 0)::double as value "
        f"from derived where {d} is not null group by {d}"
        for i, d in enumerate(dimensions) for j, m in enumerate(metrics)
    ])
    return f"""
toplists as (
  select dimension, d_pos, metric, m_pos, rank, name, {st("value", 2)} as value from (
    select *, row_number() over (partition by dimension, metric order by value desc, name)::int as rank,
           count(*) over (partition by dimension, metric) as names
    from ({lists}))
  where rank <= {n} and names > 1
)"""


TOP_INPUTS = [*DIMENSIONS, "impressions", "clicks", "conversions", "spend", "revenue", "visits"]


def top_input(spark: SparkSession, sf: str) -> DataFrame:
    return derive_metrics(perf(spark, sf, TOP_INPUTS))


@query("t01_top_performers", with_sql(PERF_SQL, DERIVED_SQL, top_sql()) + "select dimension, metric, rank, name, value from toplists")
def _t01(spark: SparkSession, sf: str) -> DataFrame:
    return top_performers(top_input(spark, sf))


@query("t01_top_performers_all_text", """
with lists as (
  select 'event_type' as dimension, 'impressions' as metric, event_type as name, sum(user_id)::double as value from events group by 3
  union all
  select 'props', 'impressions', props, sum(user_id)::double from events group by 3
)
select dimension, metric, rank, name, value from (
  select *, row_number() over (partition by dimension order by value desc, name)::int as rank,
         count(*) over (partition by dimension) as names from lists)
where rank <= 3 and names > 1
""")
def _t01_all(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select(
        "event_type", F.lit("one").alias("constant"), "props", F.col("user_id").alias("impressions")
    )
    return top_performers(df, "all", n=3)


_SEGMENT_SQL = f"""
segments as (
  select region as name, sum(revenue) as value from perf group by 1 order by 2 desc, 1 limit 8
)
select 'region' as dimension, 'revenue' as measure, row_number() over (order by value desc, name)::int as rank, name,
       {st("value", 2)} as value, {st("value / sum(value) over () * 100", 1)} as share_pct
from segments
"""


@query("t02_top_segments", PERF.rstrip() + "," + _SEGMENT_SQL)
def _t02(spark: SparkSession, sf: str) -> DataFrame:
    return top_segments(perf(spark, sf, ["region", "campaign", "revenue", "spend"]))


@query("t02_top_segments_by_count", """
with segments as (select event_type as name, count(*)::double as value from events group by 1 order by 2 desc, 1 limit 3)
select 'event_type' as dimension, 'count' as measure, row_number() over (order by value desc, name)::int as rank, name, value,
       """ + st("value / sum(value) over () * 100", 1) + """ as share_pct from segments
""")
def _t02_count(spark: SparkSession, sf: str) -> DataFrame:
    return top_segments(table(spark, sf, "events").select("event_type", "ts"), "event_type", n=3)


@query("t03_first_top_list", with_sql(PERF_SQL, DERIVED_SQL, top_sql(["campaign"], ["impressions"])) + """
select 'Top Campaign By Impressions' as title, rank, name, value from toplists
""")
def _t03(spark: SparkSession, sf: str) -> DataFrame:
    return first_top_list(top_performers(top_input(spark, sf)), DIMENSIONS)


def title_sql(column: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({column}, '_'), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ')"
    )


@query("t04_comparison_bars", with_sql(PERF_SQL, DERIVED_SQL, _SPLIT, _period_sql(BASE_METRICS)) + f"""
select pos, label, period1_total, period2_total, change_pct from (
  select row_number() over (order by list_position({BASE_METRICS}, metric))::int as pos, {title_sql("metric")} as label, *
  from periods where period1_total > 0 or period2_total > 0)
where pos <= 6
""")
def _t04(spark: SparkSession, sf: str) -> DataFrame:
    df = perf(spark, sf, ["ts", *BASE_METRICS])
    return comparison_bars(period_comparison(df), BASE_METRICS)


@query("t05_daily_series", with_sql(PERF_SQL, _SERIES_SQL) + "select day::varchar as \"date\", "
       + ", ".join(f"{st(m, 2)} as {m}" for m in _SERIES) + " from series")
def _t05(spark: SparkSession, sf: str) -> DataFrame:
    return shown(daily_series(perf(spark, sf, ["ts", *BASE_METRICS])), 2)


_GRID_SQL = f"""
grid as (
  select column1 as "row", column2 as col, {st("r", 4)} as r from corr
  union all select column2, column1, {st("r", 4)} from corr
  union all select metric, metric, 1.0 from spread where variance > 0
)"""


@query("t06_correlation_grid", with_sql(PERF_SQL, DERIVED_SQL, CORR_SQL, _VARIANCE_SQL, _WIDEST_SQL, _GRID_SQL) + """
select "row", col, r from grid where "row" in (select metric from widest) and col in (select metric from widest)
""")
def _t06(spark: SparkSession, sf: str) -> DataFrame:
    return correlation_grid(derived(spark, sf, BASE_METRICS))


@query("t07_anomaly_values", with_sql(PERF_SQL, DERIVED_SQL, anomaly_sql(ALL_METRICS, "derived")) + union_sql([
    f"""select '{m}' as metric, pos, {he(f"{m}::double", 2)} as value from (
  select {m}, row_number() over (order by {", ".join(ORDER)})::int as pos from derived, zstats
  where abs(({m} - mean_{m}) / nullif(sd_{m}, 0)) > 2.0) where pos <= 5"""
    for m in ALL_METRICS
]))
def _t07(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, [*ORDER, *BASE_METRICS])
    return anomaly_values(df, ORDER, ALL_METRICS)


@query("t08_strongest_pairs", with_sql(PERF_SQL, DERIVED_SQL, CORR_SQL, _SIGNIFICANT_SQL) + """
select rank, column1, column2 from significant where rank <= 3
""")
def _t08(spark: SparkSession, sf: str) -> DataFrame:
    return significant_pairs(derived(spark, sf, BASE_METRICS), top=3).select("rank", "column1", "column2")


@query("t09_filled_event_times", """
select event_id, strftime(coalesce(
    last_value(t ignore nulls) over (order by event_type, event_id rows between unbounded preceding and current row),
    first_value(t ignore nulls) over (order by event_type, event_id rows between current row and unbounded following)
  ), '%Y-%m-%d %H:%M:%S.%f') as filled
from (select event_id, event_type, case when event_id % 4 = 1 then ts end as t from events)
""")
def _t09(spark: SparkSession, sf: str) -> DataFrame:
    # The leading order column has five values, so ranges are cut by the second one.
    holes = F.when(F.col("event_id") % 4 == 1, F.col("ts")).alias("filled")
    df = table(spark, sf, "events").select("event_type", "event_id", holes)
    filled = fill_times(df, ["filled"], ["event_type", "event_id"])
    return filled.select("event_id", F.date_format("filled", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("filled"))


@query("t10_sorted_daily", with_sql(PERF_SQL, _SERIES_SQL) + """
select day::varchar as "date", row_number() over (order by day)::int as pos from series
""")
def _t10(spark: SparkSession, sf: str) -> DataFrame:
    series = daily_series(perf(spark, sf, ["ts", "impressions"])).withColumn("metric", F.lit("impressions"))
    place = F.row_number().over(Window.partitionBy("metric").orderBy("date"))
    return shown(series.select("date", place.alias("pos")))
