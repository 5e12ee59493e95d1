"""Schema, cleaning, derived metric, join and union queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.functions.numbers import total
from mediatally.operators.anomalies import usable_metrics
from mediatally.operators.compare import period_comparison, period_split
from mediatally.operators.derive import RATIOS, derive_metrics
from mediatally.operators.fill import fill_times
from mediatally.operators.merge import (
    merge_keys, merge_sources, merge_tables, outer_join, repeated_keys, union_all, with_source_tag,
)
from mediatally.operators.missing import (
    fill_medians, fill_missing, fill_modes, medians, missing_profile, modes,
)
from mediatally.operators.names import normalise_names
from mediatally.operators.parse import coerce_numeric, parse_time_columns
from mediatally.operators.rank import nonzero_comparison
from mediatally.operators.reshape import fan_out, melt
from mediatally.operators.roles import (
    SERIES_METRICS, available, column_roles, time_named_columns,
)
from mediatally.plans.report import transform_report
from mediatally.session import staged
from workload.registry import he, query, shown, st, union_sql, with_sql
from workload.views import (
    BASE_METRICS, DERIVED_SQL, DIMENSIONS, PERF_SQL, ROUGH_METRICS, ROUGH_SQL, ROUGH_TEXTS, ROW_IDS,
    derived, perf, rough, table,
)

PERF = with_sql(PERF_SQL)
DERIVED = with_sql(PERF_SQL, DERIVED_SQL)
ROUGH = with_sql(PERF_SQL, ROUGH_SQL)


# Schema operators -------------------------------------------------------------------------------

_HEADERS = {
    " L Order-Key ": "l_orderkey", "Total  Spend ($)": "l_extendedprice", "total-spend": "l_quantity",
    "Unit.Discount__%": "l_discount", "Émission Tax": "l_tax",
}


@query("p01_normalise_names", union_sql([
    f"select '{new}' as column_name, {st(f'sum({old})', 2)} as total from lineitem"
    for new, old in [
        ("l_order_key", "l_orderkey"), ("total_spend", "l_extendedprice"), ("total_spend_2", "l_quantity"),
        ("unit_discount", "l_discount"), ("mission_tax", "l_tax"),
    ]
]))
def _p01(spark: SparkSession, sf: str) -> DataFrame:
    odd = table(spark, sf, "lineitem").select(*[F.col(c).alias(h) for h, c in _HEADERS.items()])
    named = normalise_names(odd)
    sums = named.agg(*[total(F.col(c)).alias(c) for c in named.columns])
    return shown(sums.unpivot([], sums.columns, "column_name", "total"), 2)


def _mixed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their day written in five layouts, some of them unreadable, and a dirty number."""
    events = table(spark, sf, "events")
    layout = F.col("event_id") % 6
    day = F.col("ts")
    text = (
        F.when(layout == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(layout == 1, F.date_format(day, "M/d/yyyy"))
        .when(layout == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(layout == 3, F.date_format(day, "yyyyMMdd"))
        .when(layout == 4, F.date_format(day, "MMM d, yyyy"))
        .otherwise(F.lit("not a date"))
    )
    spend = F.when(F.col("event_id") % 7 == 0, F.lit("1,000")).when(
        F.col("event_id") % 11 == 0, F.lit("12abc")
    ).when(F.col("event_id") % 13 == 0, F.lit("NaN")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".5 ")))
    return events.select(
        "event_id", text.alias("created_date"), text.alias("spend_date"), "event_type", spend.alias("spend"),
        F.col("user_id").alias("update_count"),
    )


@query("p02_detect_time_columns", """
select 'created_date' as column_name, count(*) as filled from events
""")
def _p02(spark: SparkSession, sf: str) -> DataFrame:
    df = _mixed_events(spark, sf)
    names = time_named_columns(df)
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "filled")


@query("p03_parse_time_columns", """
select case when event_id % 6 = 5 then null
            when event_id % 6 = 2 then strftime(ts, '%Y-%m-%d %H:%M:%S')
            else strftime(ts, '%Y-%m-%d 00:00:00') end as created_date,
       count(*) as n
from events group by 1
""")
def _p03(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_time_columns(_mixed_events(spark, sf))
    return parsed.groupBy(F.date_format("created_date", "yyyy-MM-dd HH:mm:ss").alias("created_date")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("p03_day_first", """
select strftime(ts, '%Y-%m-%d') as created_date, strftime(ts, '%Y-%m-%d') as updated_date, count(*) as n from events group by 1, 2
""")
def _p03_day_first(spark: SparkSession, sf: str) -> DataFrame:
    # One column is written day first, the other month first.
    days = table(spark, sf, "events").select(F.date_format("ts", "dd/MM/yyyy").alias("created_date"), F.date_format("ts", "M/d/yyyy").alias("updated_date"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return parse_time_columns(days).groupBy(text("created_date"), text("updated_date")).agg(F.count(F.lit(1)).alias("n"))


_WRITTEN = {  # columns, as written and as SQL shows what they hold
    "short_date": ("M/d/yy", "%Y-%m-%d 00:00:00"), "month_date": ("d-MMM-yyyy", "%Y-%m-%d 00:00:00"), "clock_time": ("yyyy/MM/dd HH:mm", "%Y-%m-%d %H:%M:00"),
    "noon_time": ("MM/dd/yyyy hh:mm a", "%Y-%m-%d %H:%M:00"), "dotted_date": ("dd.MM.yyyy", "%Y-%m-%d 00:00:00"),
    "whole_month_date": ("MMMM yyyy", "%Y-%m-01 00:00:00"), "zone_time": ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "%Y-%m-%d %H:%M:%S"),
}


@query("p03_layouts", union_sql([
    f"""select '{c}' as "column", strftime(ts{" - interval 2 hour" if c == "zone_time" else ""}, '{shown_as}') as value, count(*) as n from events group by 2"""
    for c, (_, shown_as) in _WRITTEN.items()
]))
def _p03_layouts(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").select(*[F.date_format("ts", layout).alias(c) for c, (layout, _) in _WRITTEN.items()])
    parsed = parse_time_columns(days, list(_WRITTEN))
    text = parsed.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in _WRITTEN])
    return text.unpivot([], list(_WRITTEN), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@query("p04_numeric_coercion", f"""
select event_type, count(*) as n,
       count(*) filter (event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 13 <> 0) as numbers,
       {st("sum(case when event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 13 <> 0 then user_id + 0.5 end)", 2)} as spend
from events group by 1
""")
def _p04(spark: SparkSession, sf: str) -> DataFrame:
    df = coerce_numeric(_mixed_events(spark, sf))
    return shown(df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("spend").alias("numbers"), total(F.col("spend")).alias("spend")
    ), 2)


_ROLES = [("ts", "time"), *[(d, "dimension") for d in DIMENSIONS], *[(m, "metric") for m in BASE_METRICS]]


@query("p05_column_roles", PERF + union_sql([
    f"select '{c}' as column_name, '{r}' as role, count({c}) as filled from perf" for c, r in _ROLES
]))
def _p05(spark: SparkSession, sf: str) -> DataFrame:
    df = perf(spark, sf)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    roles = dict(column_roles(df))
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(roles[c]).alias("role"), F.col(c).alias("filled")) for c in df.columns]
    return counts.select(F.inline(F.array(*rows)))


@query("p06_source_tag", """
select event_type, 'structured' as data_source_type, count(*) as n from events group by 1
""")
def _p06(spark: SparkSession, sf: str) -> DataFrame:
    tagged = with_source_tag(table(spark, sf, "events"), "structured")
    return tagged.groupBy("event_type", "data_source_type").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = """
span as (select cast(min(ts) as date) as lo, cast(max(ts) as date) as hi from perf),
mids as (select lo, hi, lo + cast(floor((hi - lo) / 2) as int) as mid from span where hi - lo >= 2)"""


@query("p07_period_filter", with_sql(PERF_SQL, _SPLIT) + f"""
select case when cast(ts as date) < mid then 1 else 2 end as period, count(distinct cast(ts as date)) as days,
       {st("sum(revenue)", 2)} as revenue
from perf, mids group by 1
""")
def _p07(spark: SparkSession, sf: str) -> DataFrame:
    split = period_split(perf(spark, sf, ["ts", "revenue"]), ["revenue"])
    period = F.when(F.col("day") < F.col("mid_date"), 1).otherwise(2)
    return shown(split.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("value").alias("revenue")
    ), 2)


@query("p08_available_metrics", DERIVED + union_sql([
    f"select '{m}' as metric, {i} as pos, count({m}) as filled from derived"
    for i, m in enumerate([m for m in SERIES_METRICS if m != "foot_traffic"], start=1)
]))
def _p08(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf)
    names = available(df, SERIES_METRICS)
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    rows = [F.struct(F.lit(c).alias("metric"), F.lit(i).alias("pos"), F.col(c).alias("filled")) for i, c in enumerate(names, 1)]
    return counts.select(F.inline(F.array(*rows)))


@query("p09_drop_null_metrics", ROUGH + union_sql([
    f"select '{m}' as metric, count({m}) as \"values\" from rough having count({m}) >= 3" for m in ROUGH_METRICS
]))
def _p09(spark: SparkSession, sf: str) -> DataFrame:
    return usable_metrics(rough(spark, sf), ROUGH_METRICS)


def _period_sql(metrics: list[str], source: str = "derived") -> str:
    sums = []
    for m in metrics:
        p1 = f"coalesce(sum({m}) filter (cast(ts as date) < mid), 0)::double"
        p2 = f"coalesce(sum({m}) filter (cast(ts as date) >= mid), 0)::double"
        sums.append(
            f"select '{m}' as metric, {p1} as p1, {p2} as p2, any_value(lo) as lo, any_value(mid) as mid, any_value(hi) as hi "
            f"from {source}, mids having count(*) > 0"
        )
    return f"""
periods as (
  select metric, {st("p1", 2)} as period1_total, {st("p2", 2)} as period2_total,
         {st("case when p1 > 0 then (p2 - p1) / p1 * 100 when p2 > 0 then 100 else 0 end", 2)} as change_pct,
         lo::varchar as first_date, mid::varchar as mid_date, hi::varchar as last_date
  from ({" union all ".join(sums)})
)"""


@query("p10_nonzero_comparison", with_sql(PERF_SQL, DERIVED_SQL, _SPLIT, _period_sql(BASE_METRICS)) + """
select metric, period1_total, period2_total from periods where period1_total > 0 or period2_total > 0
""")
def _p10(spark: SparkSession, sf: str) -> DataFrame:
    df = perf(spark, sf, ["ts", *BASE_METRICS])
    return nonzero_comparison(period_comparison(df)).select("metric", "period1_total", "period2_total")


@query("p11_melt", PERF + f"""
select metric, count(*) as n, count(value) as filled, {st("sum(value)", 2)} as total
from (unpivot (select {", ".join(f"{m}::double as {m}" for m in BASE_METRICS)} from perf)
      on {", ".join(BASE_METRICS)} into name metric value value)
group by 1
""")
def _p11(spark: SparkSession, sf: str) -> DataFrame:
    long = melt(perf(spark, sf, ["order_id", *BASE_METRICS]), ["order_id"], BASE_METRICS)
    return shown(long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), total(F.col("value")).alias("total")
    ), 2)


# Missing values ---------------------------------------------------------------------------------

_FILLED = [m for m in ROUGH_METRICS if m != "foot_traffic"]


@query("m01_medians", ROUGH + union_sql([
    f"select '{m}' as metric, {he(f'median({m}::double)', 4)} as median from rough" for m in _FILLED
]))
def _m01_medians(spark: SparkSession, sf: str) -> DataFrame:
    return shown(medians(rough(spark, sf), ROUGH_METRICS), 4)


@query("m01_median_fill", with_sql(PERF_SQL, ROUGH_SQL, "med as (select "
       + ", ".join(f"median({m}::double) as {m}" for m in _FILLED) + " from rough)") + union_sql([
    f"select '{m}' as metric, count(*) as n, "
    f"{st(f'sum(coalesce({m}::double, (select med.{m} from med)))', 2)} as total from rough" for m in _FILLED
] + ["select 'foot_traffic' as metric, 0 as n, cast(null as double) as total"]))
def _m01(spark: SparkSession, sf: str) -> DataFrame:
    filled = fill_medians(rough(spark, sf).select(*ROUGH_METRICS))
    wide = filled.agg(*[F.count(m).alias(f"n_{m}") for m in ROUGH_METRICS], *[F.sum(m).alias(m) for m in ROUGH_METRICS])
    return shown(fan_out(wide, [], ROUGH_METRICS, lambda m: {
        "metric": F.lit(m), "n": F.col(f"n_{m}"), "total": F.col(m)
    }), 2)


def _mode_sql(column: str) -> str:
    return (
        f"(select {column} from rough where {column} is not null group by {column} order by count(*) desc, {column} limit 1)"
    )


@query("m02_modes", ROUGH + union_sql([
    f"select '{c}' as \"column\", {_mode_sql(c)} as mode" for c in ROUGH_TEXTS if c != "segment_note"
]))
def _m02(spark: SparkSession, sf: str) -> DataFrame:
    return modes(rough(spark, sf), ROUGH_TEXTS)


@query("m02_mode_fill", ROUGH + union_sql([
    f"select '{c}' as \"column\", coalesce({c}, {_mode_sql(c)}, 'Unknown') as value, count(*) as n from rough group by 1, 2"
    for c in ROUGH_TEXTS
]))
def _m02_fill(spark: SparkSession, sf: str) -> DataFrame:
    filled = fill_modes(rough(spark, sf).select(*ROUGH_TEXTS))
    long = filled.unpivot([], ROUGH_TEXTS, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@query("m03_unknown_fill", "select 'Unknown' as segment_note, count(*) as n from lineitem")
def _m03(spark: SparkSession, sf: str) -> DataFrame:
    filled = fill_modes(rough(spark, sf).select("segment_note"))
    return filled.groupBy("segment_note").agg(F.count(F.lit(1)).alias("n"))


_ROW_ORDER = ", ".join(ROW_IDS)


@query("m04_forward_backward_fill", ROUGH + f"""
select order_id, line_no, part_id, supplier_id, strftime(coalesce(
    last_value(ts ignore nulls) over (order by {_ROW_ORDER} rows between unbounded preceding and current row),
    first_value(ts ignore nulls) over (order by {_ROW_ORDER} rows between current row and unbounded following)
  ), '%Y-%m-%d %H:%M:%S') as ts
from rough
""")
def _m04(spark: SparkSession, sf: str) -> DataFrame:
    df = rough(spark, sf).select(*ROW_IDS, "ts")
    return fill_times(df, ["ts"], ROW_IDS).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("m04_hot_key", """
with keyed as (
  select l_orderkey as order_id, l_linenumber as line_no, l_partkey as part_id, l_suppkey as supplier_id,
         case when l_orderkey % 3 = 0 then -1 else l_orderkey end as k, case when l_orderkey % 3 = 0 then 0 else l_linenumber end as a,
         case when l_orderkey % 3 = 0 then 0 else l_partkey end as b, case when l_orderkey % 3 = 0 then 0 else l_suppkey end as c,
         case when l_linenumber = 2 then case when l_orderkey % 3 = 0 then timestamp '1990-01-01' else l_shipdate end end as seen
  from lineitem
)
select order_id, line_no, part_id, supplier_id, strftime(coalesce(last_value(seen ignore nulls) over (order by k, a, b, c
         rows between unbounded preceding and current row), timestamp '1990-01-01'), '%Y-%m-%d') as seen
from keyed
""")
def _m04_hot(spark: SparkSession, sf: str) -> DataFrame:
    # One order key holds a third of the rows; its known times are all the same, so any order within it gives one result.
    hot = F.col("l_orderkey") % 3 == 0
    or_zero = lambda c: F.when(hot, F.lit(0)).otherwise(F.col(c))
    at = F.when(hot, F.lit("1990-01-01").cast("timestamp_ntz")).otherwise(F.col("l_shipdate").cast("timestamp_ntz"))
    keyed = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"), F.when(hot, F.lit(-1)).otherwise(F.col("l_orderkey")).alias("k"),
        or_zero("l_linenumber").alias("a"), or_zero("l_partkey").alias("b"), or_zero("l_suppkey").alias("c"),
        F.when(F.col("l_linenumber") == 2, at).alias("seen"),
    )
    filled = fill_times(keyed, ["seen"], ["k", "a", "b", "c"], ranges=64)
    return filled.select("order_id", "line_no", "part_id", "supplier_id", F.date_format("seen", "yyyy-MM-dd").alias("seen"))


_ROUGH_COLUMNS = ["ts", *ROW_IDS, *ROUGH_TEXTS[:3], "segment_note", *ROUGH_METRICS]


@query("m05_missing_profile", ROUGH + union_sql([
    f"select '{c}' as \"column\", count(*) - count({c}) as missing, "
    f"{st(f'(count(*) - count({c}))::double / count(*) * 100', 4)} as missing_pct from rough"
    for c in _ROUGH_COLUMNS
]))
def _m05(spark: SparkSession, sf: str) -> DataFrame:
    return shown(missing_profile(rough(spark, sf)), 4)


def _tagged_rough(spark: SparkSession, sf: str) -> DataFrame:
    df = rough(spark, sf)
    return df.withColumn(
        "data_source_type", F.when(F.col("line_no") > 5, "unstructured").otherwise("structured")
    ).withColumn("visits", F.when(F.col("line_no") <= 5, F.col("visits")))


_TAGGED_SQL = """
tagged as (
  select * exclude (visits), case when line_no <= 5 then visits end as visits,
         case when line_no > 5 then 'unstructured' else 'structured' end as data_source_type
  from rough
)"""


@query("m01_scoped_fill", with_sql(PERF_SQL, ROUGH_SQL, _TAGGED_SQL, """
med as (select data_source_type, median(clicks::double) as clicks, median(spend) as spend, median(visits::double) as visits
        from tagged group by 1)""") + f"""
select t.data_source_type, count(*) as n, count(coalesce(t.visits, med.visits)) as visits_filled,
       {st("sum(coalesce(t.clicks::double, med.clicks))", 2)} as clicks, {st("sum(coalesce(t.spend, med.spend))", 2)} as spend,
       {st("sum(coalesce(t.visits::double, med.visits))", 2)} as visits
from tagged t join med using (data_source_type) group by 1
""")
def _m01_scoped(spark: SparkSession, sf: str) -> DataFrame:
    df = _tagged_rough(spark, sf).select("data_source_type", "clicks", "spend", "visits")
    filled = fill_missing(df, scope="data_source_type")
    return shown(filled.groupBy("data_source_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("visits").alias("visits_filled"),
        F.sum("clicks").alias("clicks"), F.sum("spend").alias("spend"), F.sum("visits").alias("visits"),
    ), 2)


# Derived metrics --------------------------------------------------------------------------------

def _ratio_query(number: int, ratio) -> None:
    m = ratio.name
    sql = DERIVED + f"""
select device, count(*) as n, count({m}) as filled, {st(f"sum({m})", 3)} as total, min({m}) as lowest, max({m}) as highest
from derived group by 1
"""

    @query(f"d{number:02d}_{m}", sql)
    def _ratio(spark: SparkSession, sf: str) -> DataFrame:
        inputs = list(dict.fromkeys(["device", ratio.numerator, ratio.denominator]))
        df = derive_metrics(perf(spark, sf, inputs))
        return shown(df.groupBy("device").agg(
            F.count(F.lit(1)).alias("n"), F.count(m).alias("filled"), total(F.col(m)).alias("total"),
            F.min(m).alias("lowest"), F.max(m).alias("highest"),
        ), 3, keep=("lowest", "highest"))


for _i, _r in enumerate(RATIOS, start=1):
    _ratio_query(_i, _r)


@query("d00_derived_rows", DERIVED + f"select {_ROW_ORDER}, {', '.join(r.name for r in RATIOS)} from derived")
def _d00(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, [*ROW_IDS, *BASE_METRICS]).select(*ROW_IDS, *[r.name for r in RATIOS])


_ROUGH_HOLES = ["ts", "campaign", "region", "channel", "segment_note", "clicks", "spend", "revenue", "visits"]


@query("d09_transform_report", ROUGH + """
select 'rows' as item, count(*)::varchar as value from rough
union all select 'columns_before', '16'
union all select 'columns_after', '22'
union all select 'datetime_columns_parsed', ''
union all select 'missing_values_handled', ("""
       + " + ".join(f"count(*) - count({c})" for c in _ROUGH_HOLES) + """)::varchar from rough
union all select 'derived_metrics_added', '6'
union all select 'aggregations_created', 'daily,weekly,by_campaign,by_region,by_channel,by_segment_note'
""")
def _d09(spark: SparkSession, sf: str) -> DataFrame:
    before = staged(rough(spark, sf), "rough")  # read for the gaps, the fills and the report
    after = derive_metrics(fill_missing(before, ROW_IDS, stored=True))
    return transform_report(before, after)


# Joins and unions -------------------------------------------------------------------------------

def _daily_ads(spark: SparkSession, sf: str) -> DataFrame:
    """Ads per day and region; some regions are null, so that null keys meet, and some have no partner."""
    df = perf(spark, sf, ["ts", "region", "device", "spend", "clicks"])
    region = F.when(F.col("device") == "N", "ADS ONLY").when(F.col("region") != "AFRICA", F.col("region"))
    return df.groupBy(F.to_date("ts").alias("Date"), region.alias("Region")).agg(
        F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks")
    )


def _traffic(spark: SparkSession, sf: str) -> DataFrame:
    df = perf(spark, sf, ["ts", "region", "device", "visits", "clicks"])
    region = F.when(F.col("device") == "A", "TRAFFIC ONLY").when(F.col("region") != "AFRICA", F.col("region"))
    return df.groupBy(F.to_date("ts").alias("date"), region.alias("region"), "device").agg(
        F.sum("visits").alias("visits"), F.sum("clicks").alias("clicks")
    )


_ADS_SQL = """
ads as (
  select cast(ts as date) as "date", case when device = 'N' then 'ADS ONLY' when region <> 'AFRICA' then region end as region,
         sum(spend) as spend, sum(clicks)::bigint as clicks
  from perf group by 1, 2
)"""
_TRAFFIC_SQL = """
traffic as (
  select cast(ts as date) as "date", case when device = 'A' then 'TRAFFIC ONLY' when region <> 'AFRICA' then region end as region,
         device, sum(visits)::bigint as visits, sum(clicks)::bigint as clicks
  from perf group by 1, 2, 3
)"""


@query("j01_merge_keys", with_sql(PERF_SQL, _ADS_SQL, _TRAFFIC_SQL) + """
select 'date' as merge_key, 1 as pos, (select count(distinct "date") from ads) as left_values,
       (select count(distinct "date") from traffic) as right_values
union all
select 'region', 2, (select count(distinct region) from ads), (select count(distinct region) from traffic)
""")
def _j01(spark: SparkSession, sf: str) -> DataFrame:
    ads, traffic = normalise_names(_daily_ads(spark, sf)), normalise_names(_traffic(spark, sf))
    keys = merge_keys([ads, traffic])

    def distinct_values(df: DataFrame, prefix: str) -> DataFrame:
        return df.agg(*[F.count_distinct(k).alias(f"{prefix}{k}") for k in keys])

    both = distinct_values(ads, "l_").crossJoin(distinct_values(traffic, "r_"))
    rows = [
        F.struct(F.lit(k).alias("merge_key"), F.lit(i).alias("pos"), F.col(f"l_{k}").alias("left_values"), F.col(f"r_{k}").alias("right_values"))
        for i, k in enumerate(keys, start=1)
    ]
    return both.select(F.inline(F.array(*rows)))


_JOINED_SQL = """
joined as (
  select coalesce(a."date", t."date") as "date", coalesce(a.region, t.region) as region, a.spend, a.clicks, t.device, t.visits
  from ads a full outer join traffic t
    on a."date" is not distinct from t."date" and a.region is not distinct from t.region
)"""


@query("j02_outer_join", with_sql(PERF_SQL, _ADS_SQL, _TRAFFIC_SQL, _JOINED_SQL) + f"""
select "date"::varchar as "date", region, {st("spend", 2)} as spend, clicks, device, visits from joined
""")
def _j02(spark: SparkSession, sf: str) -> DataFrame:
    ads, traffic = normalise_names(_daily_ads(spark, sf)), normalise_names(_traffic(spark, sf))
    return shown(outer_join(ads, traffic, ["date", "region"]), 2)


@query("j02_merge_orders", f"""
select status, n, {st("total", 2)} as total, parts from (
  select o_orderstatus as status, count(*) as n, sum(o_totalprice) as total, count(l_partkey) as parts
  from (select *, case when o_orderkey % 3 = 0 then -o_orderkey - 1 else o_orderkey end as k from orders) o
  full outer join (select *, case when l_orderkey % 2 = 0 then l_orderkey end as k from lineitem) l on o.k = l.k
  group by 1)
""")
def _j02_orders(spark: SparkSession, sf: str) -> DataFrame:
    # Keys are shifted or null, so that rows of either side stay alone.
    orders = table(spark, sf, "orders").select(
        F.expr("if(o_orderkey % 3 = 0, -o_orderkey - 1, o_orderkey)").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")
    )
    lines = table(spark, sf, "lineitem").select(
        F.expr("if(l_orderkey % 2 = 0, l_orderkey, null)").alias("ID"), F.col("l_partkey").alias("part")
    )
    merged = merge_tables([orders, lines])
    return shown(merged.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"), F.count("part").alias("parts")
    ), 2)


_FIVE = ["clicks", "conversions", "visits", "spend", "engagements"]


@query("j02_merge_five", with_sql(PERF_SQL, *[
    f"""t{i} as (select cast(ts as date) as "date", case when region <> 'AFRICA' and device <> '{d}' then region end as region,
         sum({m}) as {m} from perf group by 1, 2{', line_no' if i == 2 else ''})"""
    for i, (m, d) in enumerate(zip(_FIVE, "ANRAN"), start=1)
], *[
    f"""m{i} as (select coalesce(a."date", b."date") as "date", coalesce(a.region, b.region) as region,
         {", ".join(f"a.{m}" for m in _FIVE[:i - 1])}, b.{_FIVE[i - 1]}
         from {"t1" if i == 2 else f"m{i - 1}"} a full outer join t{i} b
         on a."date" is not distinct from b."date" and a.region is not distinct from b.region)"""
    for i in range(2, 6)
]) + f"""
select region, count(*) as n, {", ".join(f"{st(f'sum({m})', 2)} as {m}" for m in _FIVE)} from m5 group by 1
""")
def _j02_five(spark: SparkSession, sf: str) -> DataFrame:
    # Five tables with null keys; the second has several rows a key.
    tables = []
    for i, (m, d) in enumerate(zip(_FIVE, "ANRAN"), start=1):
        df = perf(spark, sf, ["ts", "region", "device", "line_no", m])
        region = F.when((F.col("region") != "AFRICA") & (F.col("device") != d), F.col("region"))
        keys = [F.to_date("ts").alias("date"), region.alias("region"), *([F.col("line_no")] if i == 2 else [])]
        tables.append(df.groupBy(*keys).agg(total(F.col(m)).alias(m)).drop("line_no"))
    merged = merge_tables(tables)
    return shown(merged.groupBy("region").agg(F.count(F.lit(1)).alias("n"), *[total(F.col(m)).alias(m) for m in _FIVE]), 2)


@query("j03_left_columns_win", with_sql(PERF_SQL, _ADS_SQL, _TRAFFIC_SQL, _JOINED_SQL) + """
select region, count(*) as n, count(clicks) as left_clicks, sum(clicks)::bigint as clicks from joined group by 1
""")
def _j03(spark: SparkSession, sf: str) -> DataFrame:
    merged = merge_tables([_daily_ads(spark, sf), _traffic(spark, sf)])
    return merged.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.count("clicks").alias("left_clicks"), F.sum("clicks").alias("clicks")
    )


@query("j02_repeated_keys", with_sql(PERF_SQL, _TRAFFIC_SQL) + """
select "date"::varchar as "date", region, count(*) as "rows" from traffic group by 1, 2 having count(*) > 1
""")
def _j02_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return shown(repeated_keys(_traffic(spark, sf), ["date", "region"]))


@query("j04_statistics_on_rows", PERF + f"""
select device, count(*) as n, {st("sum(abs(spend - m))", 2)} as spread
from perf, (select avg(spend) as m from perf) group by 1
""")
def _j04(spark: SparkSession, sf: str) -> DataFrame:
    df = perf(spark, sf, ["device", "spend"])
    mean = df.agg(F.avg("spend").alias("m"))
    return shown(df.crossJoin(F.broadcast(mean)).groupBy("device").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("spend") - F.col("m"))).alias("spread")
    ), 2)


def _order_facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").alias("spend"), F.col("o_custkey").alias("ref")
    )


def _event_facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("channel"), F.col("value").alias("score"), F.col("props").alias("ref")
    )


_UNION_SQL = """
united as (
  select o_orderpriority as channel, o_totalprice as spend, o_custkey::varchar as ref, cast(null as double) as score from orders
  union all
  select event_type, null, props, value from events
)"""
_UNION_OUT = f"""
select channel, count(*) as n, count(ref) as refs, {st("sum(spend)", 2)} as spend, {st("sum(score)", 2)} as score,
       max(ref) as last_ref"""


def _union_out(df: DataFrame, *keys: str) -> DataFrame:
    return shown(df.groupBy("channel", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("ref").alias("refs"), F.sum("spend").alias("spend"),
        F.sum("score").alias("score"), F.max("ref").alias("last_ref"),
    ), 2)


@query("u01_union_by_name", with_sql(_UNION_SQL) + _UNION_OUT + " from united group by 1")
def _u01(spark: SparkSession, sf: str) -> DataFrame:
    return _union_out(merge_tables([_order_facts(spark, sf), _event_facts(spark, sf)]))


@query("u02_merge_sources", with_sql(_UNION_SQL) + _UNION_OUT + """,
       case when spend is null then 'unstructured' else 'structured' end as data_source_type
from united group by 1, case when spend is null then 'unstructured' else 'structured' end""")
def _u02(spark: SparkSession, sf: str) -> DataFrame:
    return _union_out(merge_sources(_order_facts(spark, sf), _event_facts(spark, sf)), "data_source_type")


@query("u03_union_document_rows", """
select lang, count(*) as n, sum(length(text))::bigint as chars
from (select lang, text from documents union all select role, text from conversations) group by 1
""")
def _u03(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("lang", "text")
    turns = table(spark, sf, "conversations").select(F.col("role").alias("lang"), "text")
    return union_all([documents, turns]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query("u04_distinct_values", """
select o_orderkey, array_to_string(list_sort(list_distinct([o_orderstatus, substr(o_orderpriority, 3, 1), upper(o_orderstatus)])), ',') as found
from orders
""")
def _u04(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array("o_orderstatus", F.substring("o_orderpriority", 3, 1), F.upper("o_orderstatus"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("found")
    )
