"""Text extraction, Markdown, response and scalar function queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.functions import labels, patterns
from mediatally.functions.markdown import strip_markdown
from mediatally.functions.numbers import half_even, ratio
from mediatally.operators.documents import document_rows, document_summary, failed_documents, extract, method_counts
from mediatally.operators.responses import parse_responses
from workload.registry import he, query, shown, st, with_sql
from workload.views import CORPUS_SQL, PERF_SQL, corpus, table

CORPUS = with_sql(PERF_SQL, CORPUS_SQL)

# SQL twins of the patterns. The SQL engine's word edges are ASCII only, so edges are written out.
_EDGE_L, _EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _sql_text(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _found_sql(pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all(text, {_sql_text(pattern)}, {group})"


def _hits(spark: SparkSession, sf: str, values) -> DataFrame:
    found = corpus(spark, sf).select("doc_key", values(F.col("text")).alias("found"))
    return found.select(
        "doc_key", F.coalesce(F.size("found"), F.lit(0)).alias("hits"),
        F.when(F.size("found") > 0, F.array_join(F.col("found").cast("array<string>"), "|")).alias("found"),
    )


def _hits_sql(found: str) -> str:
    return CORPUS + f"""
select doc_key, len(found)::int as hits, case when len(found) > 0 then array_to_string(found, '|') end as found
from (select doc_key, {found} as found from corpus)
"""


_NUMBERED = [
    ("x01_percentages", "percentages"), ("x02_dollar_amounts", "dollar_amounts"), ("x08_ctr_mentions", "ctr"),
    ("x09_dates", "dates"),
]
for _name, _metric in _NUMBERED:
    @query(_name, _hits_sql(_found_sql(patterns.METRIC_PATTERNS[_metric])))
    def _text_metric(spark: SparkSession, sf: str, metric: str = _metric) -> DataFrame:
        return _hits(spark, sf, lambda t: patterns.text_matches(t, metric))


_LARGE_SQL = _found_sql(r"(\d+(?:\.\d+)?)\s*([KMB])" + _EDGE_R, 1)
_LARGE_UNIT_SQL = _found_sql(r"(\d+(?:\.\d+)?)\s*([KMB])" + _EDGE_R, 2)
_SCALED_SQL = f"""list_transform(list_zip({_LARGE_SQL}, {_LARGE_UNIT_SQL}), lambda p: p[1]::double *
  case upper(p[2]) when 'K' then 1000.0::double when 'M' then 1000000.0::double else 1000000000.0::double end)"""


@query("x03_scaled_numbers", CORPUS + f"""
select doc_key, len(found)::int as hits, case when len(found) > 0 then list_sum(found) end as total
from (select doc_key, {_SCALED_SQL} as found from corpus)
""")
def _x03(spark: SparkSession, sf: str) -> DataFrame:
    found = corpus(spark, sf).select("doc_key", patterns.scaled_matches(F.col("text")).alias("found"))
    return found.select(
        "doc_key", F.coalesce(F.size("found"), F.lit(0)).alias("hits"),
        F.aggregate("found", F.lit(0.0), lambda a, b: a + b).alias("total"),
    )


def _counted_sql(metric: str) -> str:
    return f"list_transform({_found_sql(patterns.METRIC_PATTERNS[metric])}, lambda m: replace(m, ',', '')::double)"


_COUNTED = [
    ("x04_impressions", "impressions"), ("x05_clicks", "clicks"), ("x06_conversions", "conversions"),
    ("x07_visitors", "visitors"),
]
for _name, _metric in _COUNTED:
    @query(_name, CORPUS + f"""
select doc_key, len(found)::int as hits, list_sum(found) as total, found[1] as first_value
from (select doc_key, {_counted_sql(_metric)} as found from corpus)
""")
    def _counted_metric(spark: SparkSession, sf: str, metric: str = _metric) -> DataFrame:
        found = corpus(spark, sf).select("doc_key", patterns.counted_matches(F.col("text"), metric).alias("found"))
        return found.select(
            "doc_key", F.coalesce(F.size("found"), F.lit(0)).alias("hits"),
            F.aggregate("found", F.lit(0.0), lambda a, b: a + b).alias("total"), F.get("found", F.lit(0)).alias("first_value"),
        )


_CAMPAIGNS_SQL = (
    "list_sort(list_distinct(list_filter(list_transform(list_concat("
    + ", ".join(_found_sql(p) for p in patterns.CAMPAIGN_PATTERNS)
    + r"), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: length(c) > 2)))"
)
_REGIONS_SQL = "list_filter([" + ", ".join(
    f"case when regexp_matches(text, '(?i){_EDGE_L}{r}{_EDGE_R}') then '{r}' end" for r in sorted(patterns.REGIONS)
) + "], lambda r: r is not null)"
_ENTITY_DATES_SQL = "list_sort(list_distinct(list_concat(" + ", ".join(
    _found_sql(_EDGE_L + p.removeprefix(r"\b").removesuffix(r"\b") + _EDGE_R) for p in patterns.DATE_PATTERNS
) + ")))"


@query("x10_campaign_names", _hits_sql(_CAMPAIGNS_SQL))
def _x10(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, patterns.campaigns)


@query("x11_region_words", _hits_sql(_REGIONS_SQL))
def _x11(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, patterns.regions)


@query("x12_entity_dates", _hits_sql(_ENTITY_DATES_SQL))
def _x12(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, patterns.entity_dates)


@query("x13_empty_entities", CORPUS + "select count(*) as documents, 0::bigint as products, 0::bigint as companies from corpus")
def _x13(spark: SparkSession, sf: str) -> DataFrame:
    found = extract(corpus(spark, sf)).select("entities.products", "entities.companies")
    return found.agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size("products")).alias("products"),
        F.sum(F.size("companies")).alias("companies"),
    )


_LISTS_SQL = [(m, _found_sql(patterns.METRIC_PATTERNS[m])) for m in ["percentages", "dollar_amounts", "ctr", "dates"]] + [
    ("large_numbers", _LARGE_SQL), *[(m, _found_sql(patterns.METRIC_PATTERNS[m])) for m in patterns.COUNTED],
]


@query("x14_metrics_and_entities", CORPUS + "select doc_key, "
       + ", ".join(f"nullif(len({s}), 0)::int as {m}" for m, s in _LISTS_SQL)
       + f", len({_CAMPAIGNS_SQL})::int as entity_campaigns, len({_REGIONS_SQL})::int as entity_regions, "
         f"len({_ENTITY_DATES_SQL})::int as entity_dates from corpus")
def _x14(spark: SparkSession, sf: str) -> DataFrame:
    df = extract(corpus(spark, sf))
    sizes = [F.when(F.col(f"metrics.{m}").isNotNull(), F.size(f"metrics.{m}")).alias(m) for m, _ in _LISTS_SQL]
    entities = [F.size(f"entities.{e}").alias(f"entity_{e}") for e in ("campaigns", "regions", "dates")]
    return df.select("doc_key", *sizes, *entities)


_SOURCED = {"large_numbers": _SCALED_SQL, **{m: _counted_sql(m) for m in patterns.COUNTED}}
_ENTITY_SQL = {"campaigns": _CAMPAIGNS_SQL, "regions": _REGIONS_SQL, "dates": _ENTITY_DATES_SQL}


@query("a17_document_rows", with_sql(PERF_SQL, CORPUS_SQL, "lists as (select doc_key, "
       + ", ".join(f"{s} as {m}" for m, s in _SOURCED.items()) + ", "
       + ", ".join(f"{s} as e_{m}" for m, s in _ENTITY_SQL.items()) + " from corpus)")
       + "select doc_key as source_file, 'regex' as extraction_method, "
       + ", ".join(f"list_sum({m}) as {m}_total, nullif(len({m}), 0)::bigint as {m}_count" for m in _SOURCED) + ", "
       + ", ".join(
           f"len(e_{m})::bigint as {m}_count, case when len(e_{m}) > 0 then array_to_string(e_{m}[1:5], ', ') end as {m}_list"
           for m in _ENTITY_SQL
       ) + ", 0::bigint as products_count, 0::bigint as companies_count from lists")
def _a17(spark: SparkSession, sf: str) -> DataFrame:
    return document_rows(corpus(spark, sf), "doc_key")


@query("s10_document_summary", CORPUS + """
select count(*) as files_processed, 0::bigint as files_failed, sum(length(text))::bigint as total_chars_extracted,
       'regex' as extraction_method, count(*) as files
from corpus
""")
def _s10(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus(spark, sf)
    methods = method_counts(document_rows(docs, "doc_key"))
    return document_summary(docs).crossJoin(methods)


@query("s10_failed_documents", """
select 'doc ' || doc_id as file, 'unreadable text' as error, (select count(*) from documents where lang <> 'es') as processed
from documents where lang = 'es'
""")
def _s10_failed(spark: SparkSession, sf: str) -> DataFrame:
    # Spanish texts could not be read, say; they are listed and the others go on.
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc "), "doc_id").alias("source_file"), F.when(F.col("lang") != "es", F.col("text")).alias("text"),
    )
    done = document_summary(docs).select(F.col("files_processed").alias("processed"))
    return failed_documents(docs).crossJoin(F.broadcast(done))


# Markdown and narrative responses ---------------------------------------------------------------

@query("s05_markdown_strip", r"""
with rendered as (
  select doc_id, '# Note ' || doc_id || chr(10) || '**' || lang || '** and *' || source || '*' || chr(10)
    || '- [home](http://x/' || doc_id || ') ![](a.png) ![alt](b.png)' || chr(10) || '```' || chr(10) || 'code *x* ' || lang
    || chr(10) || '```' || chr(10) || 'use `tool` here' || chr(10) || '##   ' || text || chr(10) || '  ' as text
  from documents
),
step1 as (select doc_id, regexp_replace(text, '(?m)^#+\s*', '', 'g') as text from rendered),
step2 as (select doc_id, regexp_replace(text, '\*+([^*]+)\*+', '\1', 'g') as text from step1),
step3 as (select doc_id, regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g') as text from step2),
step4 as (select doc_id, regexp_replace(text, '!\[([^\]]*)\]\([^)]+\)', '', 'g') as text from step3),
step5 as (select doc_id, regexp_replace(text, '```[\s\S]*?```', '', 'g') as text from step4),
step6 as (select doc_id, regexp_replace(text, '`([^`]+)`', '\1', 'g') as text from step5)
select doc_id, length(text) as chars, md5(text) as digest
from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from step6)
""")
def _s05(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    rendered = F.concat(
        F.lit("# Note "), d, F.lit("\n**"), F.col("lang"), F.lit("** and *"), F.col("source"), F.lit("*\n- [home](http://x/"), d,
        F.lit(") ![](a.png) ![alt](b.png)\n```\ncode *x* "), F.col("lang"), F.lit("\n```\nuse `tool` here\n##   "),
        F.col("text"), F.lit("\n  "),
    )
    plain = table(spark, sf, "documents").select("doc_id", strip_markdown(rendered).alias("text"))
    return plain.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    c, t = F.col("conv_id"), F.col("turn").cast("string")
    text = F.concat(
        F.lit("# Weekly view\n- before any section\n1. **Executive Summary** of "), c.cast("string"), F.lit("\n"),
        F.col("text"), F.lit("\n\n## Key Highlights\n- Reach grew "), t, F.lit("\n• 2) share up\n* \nplain text\n# note\n"),
        F.when(c % 3 == 0, F.lit("3. late highlights follow\n- again ")).otherwise("5 more "), t, F.lit("\n"),
        F.when(c % 4 != 1, F.lit("## Performance Issues\n1. drop in reach\n-- weak offer\n")).otherwise(""),
        F.when(c % 5 != 2, F.lit("Recommendations:\n- Spend more\n  4. Test offers  \n")).otherwise(""),
        F.when(c % 7 == 0, F.lit("- take action now\n9. not a bullet\n2. last\n")).otherwise(""),
    )
    return turns.select("conv_id", "turn", text.alias("text"))


_RESPONSES_SQL = r"""
responses as (
  select conv_id, turn, '# Weekly view' || chr(10) || '- before any section' || chr(10) || '1. **Executive Summary** of ' || conv_id
    || chr(10) || text || chr(10) || chr(10) || '## Key Highlights' || chr(10) || '- Reach grew ' || turn || chr(10) || '• 2) share up'
    || chr(10) || '* ' || chr(10) || 'plain text' || chr(10) || '# note' || chr(10)
    || case when conv_id % 3 = 0 then '3. late highlights follow' || chr(10) || '- again ' else '5 more ' end || turn || chr(10)
    || case when conv_id % 4 <> 1 then '## Performance Issues' || chr(10) || '1. drop in reach' || chr(10) || '-- weak offer' || chr(10) else '' end
    || case when conv_id % 5 <> 2 then 'Recommendations:' || chr(10) || '- Spend more' || chr(10) || '  4. Test offers  ' || chr(10) else '' end
    || case when conv_id % 7 = 0 then '- take action now' || chr(10) || '9. not a bullet' || chr(10) || '2. last' || chr(10) else '' end as text
  from conversations where role = 'assistant'
),
split as (select conv_id, turn, string_split(text, chr(10)) as parts from responses),
numbered as (
  select conv_id, turn, i, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') as line
  from (select conv_id, turn, parts, unnest(range(1, len(parts) + 1)) as i from split)
),
labelled as (
  select *, case when contains(lower(line), 'executive summary') then 'executive_summary'
                 when contains(lower(line), 'key highlight') or contains(lower(line), 'highlights') then 'key_highlights'
                 when contains(lower(line), 'performance issue') or contains(lower(line), 'issues') or contains(lower(line), 'concerns')
                   then 'performance_issues'
                 when contains(lower(line), 'recommendation') or contains(lower(line), 'action') then 'recommendations' end as head
  from numbered
),
placed as (
  select *, last_value(head ignore nulls) over w as section, count(head) over w as block
  from labelled window w as (partition by conv_id, turn order by i rows between unbounded preceding and current row)
),
heads as (
  select conv_id, turn, block, section, lead(section) over (partition by conv_id, turn order by block) as next
  from placed where head is not null
),
items as (
  select conv_id, turn, block, i, item from (
    select *, case when line <> '' and line[1] <> '#' then
        case when regexp_matches(line, '^[-•*1-5]') then nullif(regexp_replace(line, '^[-•* 0-9.)]+', ''), '')
             when section = 'executive_summary' then line end end as item
    from placed where head is null and section is not null)
  where item is not null
),
kept as (
  select h.*, row_number() over (partition by h.conv_id, h.turn, h.section order by h.block desc) as newest
  from heads h
  where exists (select 1 from items i where i.conv_id = h.conv_id and i.turn = h.turn and i.block = h.block)
    and (next is null
         or (section = 'executive_summary' and next = 'key_highlights')
         or (section = 'key_highlights' and next = 'performance_issues')
         or (section = 'performance_issues' and next = 'recommendations'))
),
rows as (
  select k.conv_id, k.turn, k.section, row_number() over (partition by k.conv_id, k.turn, k.section order by i.i)::int as pos, i.item as text
  from kept k join items i on i.conv_id = k.conv_id and i.turn = k.turn and i.block = k.block
  where newest = 1
)"""


@query("n04_split_responses", with_sql(_RESPONSES_SQL) + """
select conv_id, turn, section, pos, text from rows where section <> 'executive_summary'
union all
select conv_id, turn, section, 1, string_agg(text, ' ' order by pos) from rows where section = 'executive_summary' group by 1, 2, 3
""")
def _n04(spark: SparkSession, sf: str) -> DataFrame:
    return parse_responses(_responses(spark, sf), ["conv_id", "turn"])


# Scalar functions -------------------------------------------------------------------------------

def _row_query(name: str, source: str, ids: list[str], sql: dict[str, str], columns) -> None:
    select = ", ".join(f"{expr} as {alias}" for alias, expr in sql.items())

    @query(name, f"select {', '.join(ids)}, {select} from {source}")
    def _run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, source).select(*ids, *[c.alias(a) for a, c in columns().items()])


_row_query("f01_guarded_division", "events", ["event_id"], {
    "share": "value / nullif(user_id % 5, 0)::double", "cents": "value / nullif(event_id % 4, 0)::double * 100.0::double",
}, lambda: {
    "share": ratio(F.col("value"), F.col("user_id") % 5), "cents": ratio(F.col("value"), F.col("event_id") % 4, 100.0),
})

_row_query("f02_round_half_even", "events", ["event_id"], {
    "two": he("user_id / 8.0::double", 2), "four": he("value * value / 7.0::double", 4), "whole": he("user_id / 2.0::double", 0),
}, lambda: {
    "two": half_even(F.col("user_id") / 8.0, 2), "four": half_even(F.col("value") * F.col("value") / 7.0, 4),
    "whole": half_even(F.col("user_id") / 2.0, 0),
})


@query("f03_statistics", f"""
select event_type, {st("sum(abs(value - 50))", 4)} as distance, {st("avg(value)", 4)} as mean, min(value) as low, max(value) as high,
       {st("var_samp(value)", 4)} as variance, {st("stddev_pop(value)", 4)} as sd_pop, {st("stddev_samp(value)", 4)} as sd
from events group by 1
""")
def _f03(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return shown(table(spark, sf, "events").groupBy("event_type").agg(
        F.sum(F.abs(v - 50)).alias("distance"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.var_samp(v).alias("variance"), F.stddev_pop(v).alias("sd_pop"), F.stddev(v).alias("sd"),
    ), 4, keep=("low", "high"))


_row_query("f04_date_of_time", "events", ["event_id"], {"day": "strftime(ts, '%Y-%m-%d')"},
           lambda: {"day": F.to_date("ts").cast("string")})

_row_query("f05_week_and_year", "orders", ["o_orderkey"], {"year": "year(o_orderdate)::int", "week": "week(o_orderdate)::int"},
           lambda: {"year": F.year("o_orderdate"), "week": F.weekofyear("o_orderdate")})

_row_query("f06_date_arithmetic", "orders", ["o_orderkey"], {
    "days": "(cast(o_orderdate as date) - date '1995-01-01')::int",
    "later": "(cast(o_orderdate as date) + (o_orderkey % 30)::int)::varchar",
}, lambda: {
    "days": F.datediff("o_orderdate", F.lit("1995-01-01")),
    "later": F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")).cast("string"),
})

_row_query("f07_text_cleaning", "orders", ["o_orderkey"], {
    "cleaned": "regexp_replace(lower(trim(' ' || o_orderpriority || ' ')), '[^a-z0-9]+', '_', 'g')",
}, lambda: {
    "cleaned": F.regexp_replace(F.lower(F.trim(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))), "[^a-z0-9]+", "_"),
})


def _title_sql(column: str) -> str:
    return f"array_to_string(list_transform(string_split({column}, '_'), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ')"


_row_query("f08_title_label", "part", ["p_partkey"], {
    "label": _title_sql("replace(p_name, ' ', '_') || '_total'"),
}, lambda: {"label": labels.title_label(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_total")))})

_row_query("f09_display_formats", "orders", ["o_orderkey"], {
    "grouped": f"format('{{:,}}', o_orderkey * 1000)",
    "money": f"'$' || format('{{:,.2f}}', {he('o_totalprice', 2)})",
    "percent": f"format('{{:.2f}}', {he('o_totalprice / 1000.0::double', 2)}) || '%'",
    "multiplier": f"format('{{:.2f}}', {he('o_totalprice / 100000.0::double', 2)}) || 'x'",
}, lambda: {
    "grouped": labels.grouped_number(F.col("o_orderkey") * 1000), "money": labels.money(F.col("o_totalprice")),
    "percent": labels.percent(F.col("o_totalprice") / 1000.0), "multiplier": labels.multiplier(F.col("o_totalprice") / 100000.0),
})

_row_query("f10_name_contains", "part", ["p_partkey"], {
    "is_ring": "contains(lower(p_name), 'ring')", "is_small": "contains(lower(p_name), 'small') or contains(lower(p_type), 'small')",
}, lambda: {
    "is_ring": F.contains(F.lower("p_name"), F.lit("ring")),
    "is_small": F.contains(F.lower("p_name"), F.lit("small")) | F.contains(F.lower("p_type"), F.lit("small")),
})


def _parts() -> Column:
    return F.split("o_orderpriority", "[- ]+")


_row_query("f11_array_functions", "orders", ["o_orderkey"], {
    "n": "len(regexp_split_to_array(o_orderpriority, '[- ]+'))::int",
    "firsts": "array_to_string(regexp_split_to_array(o_orderpriority, '[- ]+')[1:2], ', ')",
    "letters": "list_sum(list_transform(regexp_split_to_array(o_orderpriority, '[- ]+'), lambda w: length(w)))::int",
    "kinds": "len(list_distinct(list_transform(regexp_split_to_array(o_orderpriority, '[- ]+'), lambda w: length(w))))::int",
}, lambda: {
    "n": F.size(_parts()),
    "firsts": F.array_join(F.slice(_parts(), 1, 2), ", "),
    "letters": F.aggregate(F.transform(_parts(), F.length), F.lit(0), lambda a, b: a + b),
    "kinds": F.size(F.array_distinct(F.transform(_parts(), F.length))),
})

_row_query("f12_json_fields", "events", ["event_id"], {
    "k": "cast(json_extract_string(props, '$.k') as bigint)",
    "wrapped": "cast(json_extract_string('{\"data\":[' || props || ']}', '$.data[0].k') as bigint)",
}, lambda: {
    "k": F.get_json_object("props", "$.k").cast("bigint"),
    "wrapped": F.get(F.from_json(
        F.concat(F.lit('{"data":['), "props", F.lit("]}")), "data array<struct<k: bigint>>"
    )["data"], F.lit(0))["k"],
})


@query("f13_split_lines", r"""
select doc_id, count(*) as lines, count(*) filter (line <> '') as filled, sum(length(regexp_replace(line, '^[-•* 0-9.)]+', '')))::bigint as chars
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1
""")
def _f13(spark: SparkSession, sf: str) -> DataFrame:
    # Counted inside the row: a document's lines are never exploded and grouped again.
    lines = F.split("text", "\n")
    stripped = F.transform(lines, lambda l: F.regexp_replace(l, r"^[-•* 0-9.)]+", ""))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(lines).cast("bigint").alias("lines"),
        F.size(F.filter(lines, lambda l: l != "")).cast("bigint").alias("filled"),
        F.aggregate(stripped, F.lit(0).cast("bigint"), lambda a, l: a + F.length(l)).alias("chars"),
    )
