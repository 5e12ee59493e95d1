"""Input views over the given tables, each as a DataFrame and as SQL text.

``perf`` is an ad-performance fact view over lineitem and its dimensions. Only the dimensions whose
columns a query asks for are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.functions.numbers import half_even
from mediatally.operators.derive import RATIOS, derive_metrics
from workload.registry import he


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BASE_METRICS = [
    "impressions", "clicks", "conversions", "spend", "revenue", "visits", "unique_visitors", "engagements",
    "weather_temp",
]
DIMENSIONS = ["campaign", "category", "region", "channel", "device"]
ORDER = ["ts", "order_id", "line_no", "part_id", "supplier_id"]
ROW_IDS = ["order_id", "line_no", "part_id", "supplier_id"]

_SOURCE = {
    "campaign": "part", "category": "part", "visits": "part",
    "weather_temp": "supplier", "region": "region", "channel": "orders",
}


def perf(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The fact view with the wanted columns (default: time, dimensions and metrics)."""
    columns = columns or ["ts", *DIMENSIONS, *BASE_METRICS]
    need = {_SOURCE[c] for c in columns if c in _SOURCE}
    df = table(spark, sf_dir, "lineitem")
    if "part" in need:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "orders" in need:
        df = df.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if need & {"supplier", "region"}:
        supplier = table(spark, sf_dir, "supplier")
        if "region" in need:
            places = table(spark, sf_dir, "nation").join(
                table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
            )
            supplier = supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        df = df.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    price = F.col("l_extendedprice")
    derived = {
        "ts": F.col("l_shipdate"),
        "order_id": F.col("l_orderkey"),
        "line_no": F.col("l_linenumber"),
        "part_id": F.col("l_partkey"),
        "supplier_id": F.col("l_suppkey"),
        "campaign": F.col("p_brand"),
        "category": F.col("p_type"),
        "region": F.col("r_name"),
        "channel": F.col("o_orderpriority"),
        "device": F.col("l_returnflag"),
        "impressions": (F.col("l_quantity") * 1000).cast("bigint"),
        "clicks": F.col("l_partkey") % 40,
        "conversions": F.col("l_linenumber").cast("bigint"),
        "spend": half_even(price * (1 - F.col("l_discount")), 2),
        "revenue": half_even(price * (1 + F.col("l_tax")), 2),
        "visits": F.col("p_size").cast("bigint"),
        "unique_visitors": F.col("l_suppkey") % 10,
        "engagements": F.col("l_orderkey") % 100,
        "weather_temp": F.col("s_nationkey").cast("bigint"),
    }
    return df.select(*[derived[c].alias(c) for c in columns])


PERF_SQL = """
perf as (
  select l_shipdate as ts, l_orderkey as order_id, l_linenumber as line_no, l_partkey as part_id,
         l_suppkey as supplier_id, p_brand as campaign, p_type as category, r_name as region,
         o_orderpriority as channel, l_returnflag as device,
         cast(l_quantity * 1000 as bigint) as impressions, l_partkey % 40 as clicks,
         cast(l_linenumber as bigint) as conversions,
         round_even(l_extendedprice * (1 - l_discount) * 100, 0) / 100 as spend,
         round_even(l_extendedprice * (1 + l_tax) * 100, 0) / 100 as revenue,
         cast(p_size as bigint) as visits, l_suppkey % 10 as unique_visitors,
         l_orderkey % 100 as engagements, cast(s_nationkey as bigint) as weather_temp
  from lineitem
  join part on l_partkey = p_partkey
  join orders on l_orderkey = o_orderkey
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
)"""


DERIVED_METRICS = ["ctr", "cpc", "cpm", "conversion_rate", "cpa", "roas", "engagement_rate", "pages_per_visit"]
ALL_METRICS = [*BASE_METRICS, *DERIVED_METRICS]


def derived(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The fact view with its ratio metrics."""
    return derive_metrics(perf(spark, sf_dir, columns))


def _ratio_sql(num: str, den: str, factor: float, digits: int, name: str) -> str:
    scaled = f"{num}::double / nullif({den}, 0)::double" + ("" if factor == 1.0 else f" * {factor}::double")
    return f"{he(scaled, digits)} as {name}"


DERIVED_SQL = "derived as (\n  select *, " + ",\n    ".join(
    _ratio_sql(r.numerator, r.denominator, r.factor, r.digits, r.name) for r in RATIOS
) + "\n  from perf\n)"


def rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact view with holes: null times, texts and numbers, one all-null text and one all-null number."""
    df = perf(spark, sf_dir, [*ORDER, "campaign", "region", "channel", "impressions", "clicks", "conversions", "spend", "revenue", "visits"])

    def hole(column: str, at: Column) -> Column:
        return F.when(~at, F.col(column)).alias(column)

    return df.select(
        hole("ts", (F.col("order_id") + F.col("line_no")) % 13 == 0),
        *ROW_IDS,
        hole("campaign", F.col("line_no") == 6),
        hole("region", F.col("order_id") % 17 == 0),
        hole("channel", F.col("part_id") % 5 == 0),
        F.lit(None).cast("string").alias("segment_note"),
        "impressions",
        hole("clicks", F.col("part_id") % 19 == 0),
        "conversions",
        hole("spend", F.col("line_no") == 7),
        hole("revenue", F.col("order_id") % 11 == 0),
        hole("visits", F.col("supplier_id") % 3 == 0),
        F.lit(None).cast("double").alias("foot_traffic"),
    )


ROUGH_SQL = """
rough as (
  select case when (order_id + line_no) % 13 <> 0 then ts end as ts, order_id, line_no, part_id, supplier_id,
         case when line_no <> 6 then campaign end as campaign,
         case when order_id % 17 <> 0 then region end as region,
         case when part_id % 5 <> 0 then channel end as channel,
         cast(null as varchar) as segment_note, impressions,
         case when part_id % 19 <> 0 then clicks end as clicks, conversions,
         case when line_no <> 7 then spend end as spend,
         case when order_id % 11 <> 0 then revenue end as revenue,
         case when supplier_id % 3 <> 0 then visits end as visits,
         cast(null as double) as foot_traffic
  from perf
)"""
ROUGH_METRICS = ["impressions", "clicks", "conversions", "spend", "revenue", "visits", "foot_traffic"]
ROUGH_TEXTS = ["campaign", "region", "channel", "segment_note"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, text): a report per region and month of the fact view, and every document."""
    facts = perf(spark, sf_dir, ["ts", "region", "impressions", "clicks", "conversions", "visits"])
    sums = facts.groupBy(
        "region", F.year("ts").alias("y"), F.month("ts").alias("m")
    ).agg(*[F.sum(c).alias(c) for c in ("impressions", "clicks", "conversions", "visits")])
    n = lambda c: F.format_number(F.col(c), 0)
    y, m = F.col("y").cast("string"), F.col("m").cast("string")
    text = F.concat(
        F.lit("Monthly summary for "), F.col("region"), F.lit(" and the Northeast, "), m, F.lit("/15/"), y, F.lit(".\n"),
        F.lit("We saw "), n("impressions"), F.lit(" impressions, "), n("clicks"), F.lit(" clicks,\n"),
        n("conversions"), F.lit("\nconversions from "), n("visits"), F.lit(" visitors; "), m, F.lit("0 Users and "),
        m, F.lit(".5M views, 3 k calls.\n"),
        F.lit("Overall CTR: 2."), m, F.lit("% (click-through rate 1."), m, F.lit("), up "), m, F.lit(" %.\n"),
        F.lit("Spend $ "), n("impressions"), F.lit(".50 against $"), n("clicks"), F.lit(".\n"),
        F.lit("Campaign: \"Winter Deal "), m, F.lit("\" and the 'Spring "), F.col("region"), F.lit(" offer' closed, promo: week "),
        m, F.lit(".\nNext review: January "), m, F.lit(", "), y, F.lit(" or "), y, F.lit("-"), m, F.lit("-28, US west"),
    )
    reports = sums.select(F.concat_ws(" ", "region", "y", "m").alias("doc_key"), text.alias("text"))
    documents = table(spark, sf_dir, "documents")
    return reports.union(documents.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), "text"))


CORPUS_SQL = """
corpus as (
  select concat_ws(' ', region, y, m) as doc_key,
    'Monthly summary for ' || region || ' and the Northeast, ' || m || '/15/' || y || '.' || chr(10)
    || 'We saw ' || format('{:,}', impressions) || ' impressions, ' || format('{:,}', clicks) || ' clicks,' || chr(10)
    || format('{:,}', conversions) || chr(10) || 'conversions from ' || format('{:,}', visits) || ' visitors; ' || m
    || '0 Users and ' || m || '.5M views, 3 k calls.' || chr(10)
    || 'Overall CTR: 2.' || m || '% (click-through rate 1.' || m || '), up ' || m || ' %.' || chr(10)
    || 'Spend $ ' || format('{:,}', impressions) || '.50 against $' || format('{:,}', clicks) || '.' || chr(10)
    || 'Campaign: "Winter Deal ' || m || '" and the ''Spring ' || region || ' offer'' closed, promo: week '
    || m || '.' || chr(10) || 'Next review: January ' || m || ', ' || y || ' or ' || y || '-' || m || '-28, US west' as text
  from (
    select region, year(ts)::varchar as y, month(ts)::varchar as m, sum(impressions)::bigint as impressions,
           sum(clicks)::bigint as clicks, sum(conversions)::bigint as conversions, sum(visits)::bigint as visits
    from perf group by 1, 2, 3
  )
  union all
  select 'doc ' || doc_id::varchar, text from documents
)"""
