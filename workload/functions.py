"""Queries for the small functions within operators: each goes through the package function that uses them, so that it fails
when that function does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.functions import patterns
from mediatally.operators.aggregate import daily, kpi_stats, weekly
from mediatally.operators.compare import period_split
from mediatally.operators.documents import document_rows
from mediatally.operators.missing import fill_medians
from mediatally.operators.names import normalise_names
from mediatally.operators.responses import parse_responses
from mediatally.operators.roles import time_named_columns
from mediatally.session import new_stage
from mediatally.sources.files import read_json
from workload.registry import query, shown, st, union_sql
from workload.views import table


@query("j04_median_beside_rows", f"""
with mid as (select median(l_extendedprice) as m from lineitem where l_orderkey % 3 <> 0)
select l_returnflag as status, {st("sum(case when l_orderkey % 3 <> 0 then l_extendedprice else m end)", 2)} as spend
from lineitem, mid group by 1
""")
def _j04(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_extendedprice")).alias("spend")
    filled = fill_medians(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("status"), gap), ["spend"])
    return shown(filled.groupBy("status").agg(F.sum("spend").alias("spend")), 2)


@query("u04_region_sets", """
select o_orderkey, case when o_orderkey % 3 = 0 then 'Midwest, West' when o_orderkey % 3 = 1 then 'Asia' else '' end as found from orders
""")
def _u04(spark: SparkSession, sf: str) -> DataFrame:
    rest = F.col("o_orderkey") % 3
    text = F.when(rest == 0, "west of the MIDWEST, West").when(rest == 1, "asia; Asia!").otherwise("Westward")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(patterns.regions(text), ", ").alias("found"))


@query("f03_kpi_statistics", f"""
select 'value' as metric, {st("sum(value)", 2)} as total, {st("avg(value)", 2)} as avg, {st("max(value)", 2)} as max, {st("min(value)", 2)} as min from events
""")
def _f03(spark: SparkSession, sf: str) -> DataFrame:
    return shown(kpi_stats(table(spark, sf, "events"), ["value"]), 2)


@query("f04_daily_dates", f"""
select strftime(ts, '%Y-%m-%d') as date, {st("sum(value)", 2)} as value_sum, {st("avg(value)", 2)} as value_mean from events group by 1
""")
def _f04(spark: SparkSession, sf: str) -> DataFrame:
    return shown(daily(table(spark, sf, "events"), ["value"], "ts"), 2)


@query("f05_weekly_years", f"""
select year(o_orderdate)::int as year, week(o_orderdate)::int as week, {st("sum(o_totalprice)", 2)} as o_totalprice_sum, {st("avg(o_totalprice)", 2)} as o_totalprice_mean
from orders group by 1, 2
""")
def _f05(spark: SparkSession, sf: str) -> DataFrame:
    return shown(weekly(table(spark, sf, "orders"), ["o_totalprice"], "o_orderdate"), 2)


@query("f06_period_borders", f"""
with ends as (select cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as b from orders)
select 'o_totalprice' as metric, a::varchar as first_date, (a + ((b - a) // 2)::int)::varchar as mid_date, b::varchar as last_date,
       (select count(distinct cast(o_orderdate as date)) from orders) as days, (select {st("sum(o_totalprice)", 2)} from orders) as total
from ends
""")
def _f06(spark: SparkSession, sf: str) -> DataFrame:
    split = period_split(table(spark, sf, "orders"), ["o_totalprice"], "o_orderdate")
    return shown(split.groupBy("metric", "first_date", "mid_date", "last_date").agg(F.count(F.lit(1)).alias("days"), F.sum("value").alias("total")), 2)


@query("f07_snake_case_names", r"""
select trim(regexp_replace(regexp_replace(lower('Total ' || o_orderpriority || ' (%)'), '[\s\-.]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_') as name, count(*) as n
from orders group by 1
""")
def _f07(spark: SparkSession, sf: str) -> DataFrame:
    heads = table(spark, sf, "orders").select(F.concat(F.lit("Total "), "o_orderpriority", F.lit(" (%)")).alias("head"))
    wide = normalise_names(heads.groupBy().pivot("head").agg(F.count(F.lit(1))))  # one column for each of five priorities
    return wide.unpivot([], wide.columns, "name", "n")


_TIMES = {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}


@query("f10_time_names", union_sql([f"select '{t}' as \"table\", '{c}' as name, count({c}) as filled from {t}" for t, cs in _TIMES.items() for c in cs]))
def _f10(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name in _TIMES:
        df = table(spark, sf, name)
        found = time_named_columns(df)
        parts.append(df.agg(*[F.count(c).alias(c) for c in found]).unpivot([], found, "name", "filled").select(F.lit(name).alias("table"), "name", "filled"))
    return parts[0].unionByName(parts[1])


@query("f11_document_lists", """
select o_orderkey, (o_orderkey + o_custkey)::double as clicks_total, 2::bigint as clicks_count, 'Asia, West' as regions_list from orders
""")
def _f11(spark: SparkSession, sf: str) -> DataFrame:
    words = [F.col("o_orderkey").cast("string"), F.lit(" clicks in the West and "), F.col("o_custkey").cast("string"), F.lit(" clicks in Asia")]
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("source_file"), F.concat(*words).alias("text"))
    return document_rows(docs).select(F.col("source_file").cast("bigint").alias("o_orderkey"), "clicks_total", "clicks_count", "regions_list")


@query("f12_json_envelopes", """
select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by 1
""")
def _f12(spark: SparkSession, sf: str) -> DataFrame:
    path = new_stage(spark, "envelopes") + ".json"
    record = F.concat(F.lit('{"data":[{"kind":"'), "event_type", F.lit('","p":'), "props", F.lit("}]}"))
    table(spark, sf, "events").select(record.alias("value")).write.text(path)
    return read_json(spark, path, lines=True).groupBy(F.col("kind").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


@query("f13_response_lines", """
select o_orderkey, 'recommendations' as section, 1 as pos, 'Check ' || o_orderpriority as "text" from orders
union all select o_orderkey, 'recommendations', 2, 'Status ' || o_orderstatus from orders
""")
def _f13(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.lit("Recommendations:\r\n\n - Check "), "o_orderpriority", F.lit("  \nno bullet\n# heading\n* Status "), "o_orderstatus", F.lit("\n-\n")]
    return parse_responses(table(spark, sf, "orders").select("o_orderkey", F.concat(*parts).alias("text")), ["o_orderkey"])
