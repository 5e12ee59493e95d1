"""Structured Streaming queries over files derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.functions.numbers import total
from mediatally.session import new_stage
from mediatally.streaming.daily import append_rows, arriving_csv, daily_kpis, latest_days, update_days
from workload.registry import query, shown, st, with_sql
from workload.views import DERIVED_SQL, PERF_SQL, perf, table


@query("r01_incremental_ingest", with_sql(PERF_SQL, DERIVED_SQL) + f"""
select device, count(*) as n, {st("sum(spend)", 2)} as spend, count(ctr) as ctr_filled, {st("sum(ctr)", 3)} as ctr,
       {st("sum(roas)", 3)} as roas, count(distinct strftime(ts, '%Y-%m-%d')) as days
from derived group by 1
""")
def _r01(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_stage(spark, "arriving")
    df = perf(spark, sf, ["ts", "device", "impressions", "clicks", "spend", "revenue"])
    day = F.date_format("ts", "M/d/yyyy").alias("Report Date")
    odd = df.select(day, F.col("device").alias("Device"), F.col("impressions").alias("Impressions"),
                    F.col("clicks").alias("Clicks"), F.col("spend").alias(" Spend "), F.col("revenue").alias("Revenue"))
    odd.write.option("header", True).csv(f"{folder}/in")
    schema = "`Report Date` string, Device string, Impressions string, Clicks string, ` Spend ` string, Revenue string"
    rows = arriving_csv(spark, f"{folder}/in", schema)
    append_rows(rows, f"{folder}/out", f"{folder}/progress").awaitTermination()
    return shown(spark.read.parquet(f"{folder}/out").groupBy("device").agg(
        F.count(F.lit(1)).alias("n"), F.sum("spend").alias("spend"), F.count("ctr").alias("ctr_filled"),
        total(F.col("ctr")).alias("ctr"), total(F.col("roas")).alias("roas"),
        F.count_distinct("report_date").alias("days"),
    ), 3, keep=("spend",)).withColumn("spend", F.round("spend", 2))


@query("r01_quoted_and_latin", r"""
select doc_id, n_chars as spend, md5('"' || coalesce(lang, '') || '", é, ' || regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')) as digest from documents
""")
def _r01_quoted(spark: SparkSession, sf: str) -> DataFrame:
    # Quotes and commas within cells; texts that Latin-1 can hold arrive in that encoding, others in UTF-8.
    folder = new_stage(spark, "arriving")
    note = F.concat(F.lit('"'), F.coalesce("lang", F.lit("")), F.lit('", é, '), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "))
    docs = table(spark, sf, "documents").select("doc_id", note.alias("Note"), F.col("n_chars").alias("Spend"))
    latin = F.col("Note").rlike(r"\A[\x00-\xFF]*\z")
    writer = {"escape": '"', "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.where(latin).write.options(**writer, encoding="ISO-8859-1").csv(f"{folder}/in")
    docs.where(~latin).write.options(**writer).mode("append").csv(f"{folder}/in")
    rows = arriving_csv(spark, f"{folder}/in", "doc_id bigint, Note string, Spend bigint", files_per_trigger=8)
    append_rows(rows, f"{folder}/out", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "spend", F.md5("note").alias("digest"))


_FLOW_SQL = """
flow as (
  select event_id, ts, (event_type = 'view')::int * 100 as impressions, (event_type = 'click')::int as clicks,
         (event_type = 'purchase')::int as conversions, value as spend,
         case when event_type = 'purchase' then value * 3 else 0 end as revenue
  from events
),
days as (
  select cast(ts as date) as day, sum(impressions)::double as impressions, sum(clicks)::double as clicks,
         sum(conversions)::double as conversions, sum(spend) as spend, sum(revenue) as revenue
  from flow group by 1
)"""


_DAYS_SQL = f"""
select day::varchar as "date", impressions as impressions_sum, clicks as clicks_sum, conversions as conversions_sum,
       {st("spend", 2)} as spend_sum, {st("revenue", 2)} as revenue_sum,
       case when impressions > 0 then {st("clicks / impressions * 100", 4)} else 0 end as overall_ctr,
       case when clicks > 0 then {st("spend / clicks", 4)} else 0 end as overall_cpc,
       case when impressions > 0 then {st("spend / impressions * 1000", 4)} else 0 end as overall_cpm,
       case when clicks > 0 then {st("conversions / clicks * 100", 4)} else 0 end as overall_conversion_rate,
       case when conversions > 0 then {st("spend / conversions", 4)} else 0 end as overall_cpa,
       case when spend > 0 then {st("revenue / spend", 4)} else 0 end as overall_roas
from days
"""
_FLOW_METRICS = ["impressions", "clicks", "conversions", "spend", "revenue"]


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    is_kind = lambda name: (kind == name).cast("int")
    return table(spark, sf, "events").select(
        "event_id", "ts", (is_kind("view") * 100).alias("impressions"), is_kind("click").alias("clicks"),
        is_kind("purchase").alias("conversions"), F.col("value").alias("spend"),
        F.when(kind == "purchase", F.col("value") * 3).otherwise(0.0).alias("revenue"),
    )


def _streamed_days(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The days of the files under folder/in, streamed."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/in").drop("part").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    days = daily_kpis(reader.parquet(f"{folder}/in"), "ts", _FLOW_METRICS)
    update_days(days, f"{folder}/out", f"{folder}/progress").awaitTermination()
    money = ("spend_sum", "revenue_sum")
    found = latest_days(spark, f"{folder}/out")
    return shown(shown(found, 2, keep=tuple(c for c in found.columns if c not in money)), 4, keep=money)


@query("r02_daily_kpi_stream", with_sql(_FLOW_SQL) + _DAYS_SQL)
def _r02(spark: SparkSession, sf: str) -> DataFrame:
    # Every day of the input, those the watermark has not passed included.
    folder = new_stage(spark, "flow")
    _flow(spark, sf).write.parquet(f"{folder}/in")
    return _streamed_days(spark, folder)


@query("r02_late_rows", with_sql(_FLOW_SQL.replace("from events", """from (
    select *, max(ts) over () - interval 1 day as mark from events)
  where event_id % 10 <> 0 or ts = mark + interval 1 day or cast(ts as date) + interval 1 day > mark""")) + _DAYS_SQL)
def _r02_late(spark: SparkSession, sf: str) -> DataFrame:
    # Every tenth event arrives after all the others: what lies in days behind the watermark by then is dropped. The
    # watermark of a batch judges the rows of the batch after the next one, so a few new rows arrive in between. An arrival is
    # a folder of files, taken up by a run of the stream of its own.
    folder = new_stage(spark, "late")
    flow = _flow(spark, sf)
    newest = F.broadcast(flow.agg(F.max("ts").alias("newest")))
    late, new = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.col("newest")), F.col("ts") > F.col("newest") - F.expr("interval 6 hours")
    arrival = F.when(late, 2).when(new & (F.col("ts") < F.col("newest")), 1).otherwise(0)
    flow = flow.crossJoin(newest).withColumn("arrival", arrival).drop("newest")
    for k in range(3):
        flow.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        found = _streamed_days(spark, folder)
    return found
