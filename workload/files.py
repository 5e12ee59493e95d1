"""Source and sink queries: each writes files derived from the given tables and reads them back."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.plans.report import Stored, aggregations
from mediatally.session import new_stage, staged
from mediatally.operators.aggregate import by_dimension
from mediatally.operators.names import name_mapping
from mediatally.sources.batch import ingest_statistics, ingest_totals, list_entries, mapping_frame, read_batch, read_entry
from mediatally.sources.files import (
    invalid_utf8_files, read_csv, read_json, read_markdown, read_parquet, read_text, snapshot, write_stage,
)
from workload.cleaning import _ADS_SQL, _JOINED_SQL, _TRAFFIC_SQL, _daily_ads, _traffic
from workload.registry import query, shown, st, union_sql, with_sql
from workload.views import DIMENSIONS, ORDER, PERF_SQL, perf, table


@query("s01_csv_scan", f"""
select o_orderpriority, count(*) as n, {st("sum(o_totalprice)", 2)} as total, strftime(min(o_orderdate), '%Y-%m-%d') as first_day,
       strftime(max(o_orderdate), '%Y-%m-%d') as last_day, sum(o_custkey)::bigint as customers
from orders group by 1
""")
def _s01(spark: SparkSession, sf: str) -> DataFrame:
    path = new_stage(spark, "orders") + ".csv"
    table(spark, sf, "orders").write.option("header", True).csv(path)
    df = read_csv(spark, path)
    return shown(df.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"),
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), F.sum("o_custkey").alias("customers"),
    ), 2)


@query("s01_missing_tokens", f"""
select o_orderstatus, count(*) as n, count(*) filter (o_orderkey % 5 <> 0) as prices,
       {st("sum(case when o_orderkey % 5 <> 0 then o_totalprice end)", 2)} as total,
       sum(case when o_orderkey % 7 <> 0 then o_custkey end)::bigint as customers,
       count(*) filter (o_orderkey % 3 <> 0) as notes, 'double' as price_type, 'bigint' as customer_type
from orders group by 1
""")
def _s01_tokens(spark: SparkSession, sf: str) -> DataFrame:
    path = new_stage(spark, "tokens") + ".csv"
    gap = lambda n, token, c: F.when(F.col("o_orderkey") % n == 0, F.lit(token)).otherwise(F.col(c).cast("string"))
    table(spark, sf, "orders").select(
        "o_orderstatus", gap(5, "NA", "o_totalprice").alias("price"), gap(7, "N/A", "o_custkey").alias("customer"),
        gap(3, "None", "o_orderpriority").alias("note"),
    ).write.option("header", True).csv(path)
    df = read_csv(spark, path)
    kinds = dict(df.dtypes)
    return shown(df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("prices"), F.sum("price").alias("total"),
        F.sum("customer").alias("customers"), F.count("note").alias("notes"),
    ), 2).withColumns({"price_type": F.lit(kinds["price"]), "customer_type": F.lit(kinds["customer"])})


@query("s01_unnamed_and_repeated_headers", f"""
select o_orderstatus as status, count(*) as n, min(o_orderkey)::bigint as first_row, sum(o_custkey)::bigint as spend_1, {st("sum(o_totalprice)", 2)} as spend,
       strftime(max(o_orderdate), '%Y-%m-%d') as last_day, 'bigint,date,string,double,bigint' as kinds
from orders group by 1
""")
def _s01_headers(spark: SparkSession, sf: str) -> DataFrame:
    # The first column has no name, as an index written along has none; two others share theirs. Each part file has the header.
    path = new_stage(spark, "headers") + ".csv"
    cells = ["o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus", F.col("o_totalprice").cast("string"), "o_custkey"]
    lines = table(spark, sf, "orders").select(F.concat_ws(",", *cells).alias(",day,status,spend,spend"))
    lines.write.options(header=True, sep="\x01", quote="").csv(path)
    df = read_csv(spark, path)
    kinds = ",".join(dict(df.dtypes)[c] for c in ("unnamed_0", "day", "status", "spend", "spend_1"))
    return shown(df.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("unnamed_0").alias("first_row"), F.sum("spend_1").alias("spend_1"), F.sum("spend").alias("spend"),
        F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"),
    ), 2).withColumn("kinds", F.lit(kinds))


@query("s01_quoted_breaks", r"""
select conv_id, turn, md5(regexp_replace(coalesce(nullif(text, ''), ''), '\r\n?', chr(10), 'g')) as digest from conversations
""")
def _s01_breaks(spark: SparkSession, sf: str) -> DataFrame:
    path = new_stage(spark, "quoted") + ".csv"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    turns.write.options(header=True, escape='"', quoteAll=True).csv(path)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    return read_csv(spark, path).select("conv_id", "turn", F.md5(text).alias("digest"))


@query("s02_encoding_fallback", r"""
select doc_id, lang, md5(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) as digest from documents
""")
def _s02(spark: SparkSession, sf: str) -> DataFrame:
    # French texts that Latin-1 can hold go out as Latin-1, all others as UTF-8.
    folder = new_stage(spark, "encodings")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    latin = (F.col("lang") == "fr") & F.col("text").rlike(r"\A[\x00-\xFF]*\z")
    writer = {"escape": '"', "header": True}
    docs.where(latin).write.options(**writer, encoding="ISO-8859-1").csv(f"{folder}/french.csv")
    docs.where(~latin).write.options(**writer).csv(f"{folder}/others.csv")
    df = read_csv(spark, [f"{folder}/french.csv", f"{folder}/others.csv"], "doc_id bigint, lang string, text string", multiline=True)
    return df.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("s02_mixed_types", """
select lang, count(*) as n, count(distinct value) as "values" from (
  select 'fr' as lang, 'é' || n_chars as value from documents where lang = 'fr' union all select lang, n_chars::varchar from documents where lang <> 'fr')
group by 1
""")
def _s02_types(spark: SparkSession, sf: str) -> DataFrame:
    # One file holds text and is Latin-1, the others numbers and are UTF-8: one column all the same.
    folder = new_stage(spark, "mixed")
    docs = table(spark, sf, "documents")
    french = docs.where("lang = 'fr'").select("lang", F.concat(F.lit("é"), "n_chars").alias("value"))
    french.write.options(header=True, encoding="ISO-8859-1").csv(f"{folder}/a.csv")
    docs.where("lang <> 'fr'").select("lang", F.col("n_chars").alias("value")).write.option("header", True).csv(f"{folder}/b.csv")
    df = read_csv(spark, [f"{folder}/a.csv", f"{folder}/b.csv"])
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"))


@query("s02_odd_file_names", union_sql([
    f"select '{name}' as filename, count(*) as n, sum(o_orderkey)::bigint as keys from orders"
    for name in ("a [1].csv", "c d.csv", "nested.csv", "é{x}*.csv")
]))
def _s02_names(spark: SparkSession, sf: str) -> DataFrame:
    # Blanks, brackets and braces in names, Latin-1 behind them, and a folder whose files lie deeper.
    folder = new_stage(spark, "odd names")
    orders = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(" é")).alias("name"))
    for path in ("a [1].csv", "c d.csv", "nested.csv/2024/x", "é{x}*.csv"):
        orders.write.options(header=True, encoding="ISO-8859-1").csv(f"{folder}/{path}")
    parts = []
    for e in list_entries(spark, folder):
        df = read_entry(spark, e).where(F.col("name").endswith(" é"))
        parts.append(df.agg(F.lit(e.name).alias("filename"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")))
    return reduce(DataFrame.unionByName, parts)


@query("s02_invalid_files", "select count(*) as latin_lines, 0::bigint as utf8_lines from documents")
def _s02_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_stage(spark, "encodings")
    line = F.concat("lang", F.lit(" é "), F.regexp_replace("text", r"[^\x00-\xFF]|[\r\n]", " "))
    docs = table(spark, sf, "documents").select(line.alias("value"))
    docs.write.option("encoding", "ISO-8859-1").csv(f"{folder}/latin")
    docs.write.csv(f"{folder}/utf8")
    both = [f"{folder}/latin", f"{folder}/utf8"]
    lines = spark.read.text(both).select(F.col("_metadata.file_path").alias("path"))
    flagged = lines.join(invalid_utf8_files(spark, both), "path", "left_semi")
    return flagged.agg(
        F.count_if(F.contains("path", F.lit("/latin/"))).alias("latin_lines"),
        F.count_if(F.contains("path", F.lit("/utf8/"))).alias("utf8_lines"),
    )


@query("s03_json_scan", f"""
select 'records' as shape, count(*) as n, {st("sum(o_totalprice)", 2)} as total from orders
union all select 'data_records', 2 * count(*), {st("sum(o_totalprice) + sum(o_custkey)", 2)} from orders
union all select 'data_columns', 2 * count(*), {st("sum(o_totalprice) + sum(o_custkey)", 2)} from orders
union all select 'data_object', count(*), {st("sum(o_totalprice)", 2)} from orders
""")
def _s03(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_stage(spark, "json")
    price, key = F.col("o_totalprice"), F.col("o_custkey").cast("double")
    one = lambda kind, amount: F.struct(F.lit(kind).alias("kind"), amount.alias("amount"))
    shapes = {
        "records": [F.lit("price").alias("kind"), price.alias("amount")],
        "data_records": [F.array(one("price", price), one("key", key)).alias("data")],
        "data_columns": [F.struct(
            F.array(F.lit("price"), F.lit("key")).alias("kind"), F.array(price, key).alias("amount")
        ).alias("data")],
        "data_object": [one("price", price).alias("data")],
    }
    parts = []
    for shape, columns in shapes.items():
        table(spark, sf, "orders").select(*columns).write.json(f"{folder}/{shape}.json")
        df = read_json(spark, f"{folder}/{shape}.json", lines=True)
        parts.append(df.agg(F.lit(shape).alias("shape"), F.count("kind").alias("n"), F.sum("amount").alias("total")))
    return shown(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), 2)


@query("s03_records_with_data", f"""
select o_orderstatus as status, count(*) as n, sum(o_orderkey)::bigint as ids, {st("sum(o_totalprice)", 2)} as amount from orders group by 1
""")
def _s03_data(spark: SparkSession, sf: str) -> DataFrame:
    # One top-level array per file; its records have a field named data, and others.
    path = new_stage(spark, "records") + ".json"
    record = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("x")).alias("data"))
    arrays = table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 10000").alias("file")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    df = read_json(spark, path)
    return shown(df.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum("data.x").alias("amount")), 2)


@query("s03_large_array", f"""
select o_orderstatus as status, count(*) as n, sum(o_orderkey)::bigint as ids, {st("sum(o_totalprice)", 2)} as amount, count(*) as notes, 1::bigint as marked
from orders group by 1
""")
def _s03_array(spark: SparkSession, sf: str) -> DataFrame:
    # One array per million orders, read by several tasks, because files of this size count as large here. Strings hold
    # braces, brackets and quotes.
    path = new_stage(spark, "array") + ".json"
    note = F.concat(F.lit('}] \\"{ '), "o_orderpriority", F.lit("\\"))
    record = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("x"), F.array(note).alias("notes")).alias("more"))
    orders = table(spark, sf, "orders").withColumn("part", F.expr("o_orderkey div 1000000"))
    rows = orders.select("part", F.lit(1).alias("place"), F.concat(F.lit(","), F.to_json(record)).alias("value"))
    edges = orders.select("part").distinct().select("part", F.inline(F.expr("array(struct(0 as place, '[{}' as value), struct(2 as place, ']' as value))")))
    # A task sorts about one part: dealt by a hash, several would meet in one.
    dealt = rows.unionByName(edges).repartitionByRange(max(1, orders.select("part").distinct().count()), "part")
    dealt.sortWithinPartitions("part", "place").drop("place").write.partitionBy("part").text(path)
    df = read_json(spark, path, split_above=1 << 16).where("id is not null")
    same = F.get("more.notes", F.lit(0)).startswith('}] \\"{ ') & F.get("more.notes", F.lit(0)).endswith("\\")
    return shown(df.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum("more.x").alias("amount"), F.count_if(same).alias("notes"),
        F.min((F.col("part") == F.expr("id div 1000000")).cast("bigint")).alias("marked"),
    ), 2)


def _marked_files(spark: SparkSession, sf: str, name: str, lead: str) -> str:
    """Documents packed into text files of at most 50, each document after a mark with its number."""
    path = new_stage(spark, name)
    value = F.concat(F.lit(lead), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    table(spark, sf, "documents").select(value.alias("value")).write.option("maxRecordsPerFile", 50).text(path)
    return path


def _unmarked(files: DataFrame, lead: str) -> DataFrame:
    pieces = files.select(F.explode(F.split("text", lead)).alias("piece")).where(F.col("piece").rlike(r"^\d+\n"))
    number = F.regexp_extract("piece", r"^(\d+)\n", 1)
    return pieces.select(number.cast("bigint").alias("doc_id"), F.substring("piece", F.length(number) + 2, F.length("piece")).alias("text"))


@query("s04_text_scan", "select doc_id, length(text)::int as chars, md5(text) as digest from documents")
def _s04(spark: SparkSession, sf: str) -> DataFrame:
    files = read_text(spark, _marked_files(spark, sf, "texts", "@@doc-"))
    docs = _unmarked(files, "@@doc-").withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    return docs.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query("s05_markdown_scan", r"""
select doc_id, lang as label, md5(regexp_replace(translate(text, '*`[]#', '+^()='), '\s+', ' ', 'g')) as digest from documents
""")
def _s05(spark: SparkSession, sf: str) -> DataFrame:
    # Each whole document stands under a heading with a link. Its own marks are replaced by plain signs, because a mark of
    # one document could pair with one of the next in the file.
    path = new_stage(spark, "notes")
    value = F.concat(
        F.lit("## **Document** @@"), F.col("doc_id").cast("string"), F.lit("@@ [*"), "lang", F.lit("*](http://x)\n\n"), F.translate("text", "*`[]#", "+^()="),
    )
    table(spark, sf, "documents").select(value.alias("value")).write.option("maxRecordsPerFile", 50).text(path)
    pieces = read_markdown(spark, path).select(F.explode(F.split("text", r"Document @@")).alias("piece")).where(F.col("piece").rlike(r"^\d+@@"))
    head = r"^(\d+)@@ (\w*)"
    text = F.regexp_replace(F.regexp_replace("piece", head + r"\n\n", ""), r"\n\z", "")
    return pieces.select(
        F.regexp_extract("piece", head, 1).cast("bigint").alias("doc_id"), F.regexp_extract("piece", head, 2).alias("label"),
        F.md5(F.regexp_replace(text, r"\s+", " ")).alias("digest"),
    )


def _write_files(texts: DataFrame, path: str, of_a_task: int = 200) -> None:
    """A file for each text, a line break behind it. A file costs the same whatever it holds, so texts are dealt to tasks by their
    number, however few bytes or row groups they come in.

    Under a ``file:`` path tasks open the files themselves, because Hadoop's local file system starts two processes for each of
    them. They are made in a hidden folder of the attempt, since one folder takes one new file at a time, and an attempt that runs
    again gives the same texts the same names. Any other store is left to Spark's writer, where each task moves its files into
    place (committer 2): the driver would move one by one.
    """
    found = texts.count()
    dealt = texts.repartition(max(1, -(-found // of_a_task)))
    if not found or not path.startswith("file:"):
        dealt.write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
        return
    folder = "/" + path.removeprefix("file:").lstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, done = TaskContext.get(), 0
        hidden = f"{folder}/_attempt-{context.taskAttemptId()}"
        os.makedirs(hidden)
        for batch in batches:
            for content in batch.column(0).to_pylist():
                name = f"part-{context.partitionId():05d}-{done:05d}.txt"
                with open(f"{hidden}/{name}", "wb") as file:
                    file.write(content)
                os.replace(f"{hidden}/{name}", f"{folder}/{name}")
                done += 1
        os.rmdir(hidden)
        yield pa.RecordBatch.from_pydict({"files": [done]})

    content = F.concat(F.coalesce(*texts.columns, F.lit("")), F.lit("\n")).cast("binary")
    rows = dealt.select(content.alias("content")).sortWithinPartitions("content")
    written = rows.mapInArrow(write, "files long").agg(F.sum("files")).first()[0]
    if written != found:
        raise ValueError(f"{written} files of {found} texts in {path}")


def _batch_folder(spark: SparkSession, sf: str) -> str:
    """A batch with two tables sharing date and region, and text and Markdown documents."""
    folder = new_stage(spark, "batch")
    _daily_ads(spark, sf).write.option("header", True).csv(f"{folder}/ads.csv")
    _traffic(spark, sf).write.json(f"{folder}/traffic.json")
    stored = unquote(spark.read.text(f"{folder}/ads.csv").inputFiles()[0]).split("/ads.csv/")[0]  # as Spark calls it, with its store
    notes = table(spark, sf, "conversations")
    _write_files(notes.select(F.concat(F.lit("Seen 1,200 clicks.\n"), "text").alias("value")), f"{stored}/notes.txt")
    _write_files(table(spark, sf, "benchmark").select("text"), f"{stored}/notes.md")
    table(spark, sf, "region").write.parquet(f"{folder}/ignored.parquet")
    return folder


@query("s06_batch_scan", with_sql(PERF_SQL, _ADS_SQL, _TRAFFIC_SQL) + """
select 1 as pos, 'ads.csv' as filename, 'csv' as "type", 'structured' as category, count(*) as size from ads
union all select 2, 'traffic.json', 'json', 'structured', count(*) from traffic
union all select 3, 'notes.txt', 'txt', 'unstructured', sum(length(text) + 20)::bigint from conversations
union all select 4, 'notes.md', 'md', 'unstructured', sum(length(text))::bigint from benchmark
""")
def _s06(spark: SparkSession, sf: str) -> DataFrame:
    # Size is rows for tables and characters for texts; a Markdown file loses its closing line break.
    parts = []
    for pos, e in enumerate(list_entries(spark, _batch_folder(spark, sf)), start=1):
        df = read_entry(spark, e)
        size = F.count(F.lit(1)) if e.category == "structured" else F.sum(F.length("text"))
        parts.append(df.agg(size.alias("size")).select(
            F.lit(pos).alias("pos"), F.lit(e.name).alias("filename"), F.lit(e.kind).alias("type"),
            F.lit(e.category).alias("category"), "size",
        ))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


@query("s06_batch_table", with_sql(PERF_SQL, _ADS_SQL, _TRAFFIC_SQL, _JOINED_SQL) + f"""
select region, count(*) as n, {st("sum(spend)", 2)} as spend, sum(clicks)::bigint as clicks, sum(visits)::bigint as visits,
       'structured' as data_source_type
from joined group by 1
union all select null, (select count(*) from conversations) + (select count(*) from benchmark), null, null, null, 'unstructured'
""")
def _s06_table(spark: SparkSession, sf: str) -> DataFrame:
    # Every document is a file, so the document rows are as many as the texts.
    merged = read_batch(spark, _batch_folder(spark, sf)).table
    return shown(merged.groupBy("region", "data_source_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"),
        F.sum("visits").alias("visits"),
    ), 2)


@query("s07_parquet_scan", f"""
select l_returnflag, count(*) as n, count(case when l_discount > 0 then l_tax end) as filled,
       {st("sum(case when l_discount > 0 then l_tax end)", 4)} as tax
from lineitem group by 1
""")
def _s07(spark: SparkSession, sf: str) -> DataFrame:
    # Zero discounts are written as NaN, which the reader turns into null.
    path = new_stage(spark, "lines")
    lines = table(spark, sf, "lineitem")
    tax = F.when(F.col("l_discount") > 0, F.col("l_tax")).otherwise(F.lit(float("nan")))
    lines.select("l_returnflag", "l_shipdate", tax.alias("tax")).write.parquet(path)
    return shown(read_parquet(spark, path).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("tax").alias("filled"), F.sum("tax").alias("tax")
    ), 4)


_STAGED = ["daily", "weekly", *[f"by_{d}" for d in DIMENSIONS]]


@query("s08_stage_tables", with_sql(PERF_SQL) + union_sql([
    f"select 'daily' as name, count(*) as \"rows\", {st('sum(s)', 2)} as spend from (select sum(spend) as s from perf group by cast(ts as date))",
    f"select 'weekly', count(*), {st('sum(s)', 2)} from (select sum(spend) as s from perf group by year(ts), week(ts))",
    *[f"select 'by_{d}', count(*), {st('sum(s)', 2)} from (select sum(spend) as s from perf group by {d})" for d in DIMENSIONS],
]))
def _s08(spark: SparkSession, sf: str) -> DataFrame:
    # Three aggregates read the table; its joins are made once.
    df = staged(perf(spark, sf, ["ts", *DIMENSIONS, "spend", "revenue"]), "perf")
    folder = new_stage(spark, "aggregations")
    per_dimension = read_parquet(spark, write_stage({"by_dimension": by_dimension(df)}, folder)[0])
    paths = write_stage(aggregations(df, Stored(by_dimension=per_dimension)), folder)
    parts = [
        read_parquet(spark, path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum("spend_sum").alias("spend"))
        for name, path in zip(_STAGED, paths)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return shown(result, 2)


@query("s09_ingest_statistics", with_sql(PERF_SQL, _ADS_SQL, _TRAFFIC_SQL) + """
select 'ads.csv' as filename, 'csv' as "type", 'structured' as category, count(*) as "rows", 4 as columns from ads
union all select 'traffic.json', 'json', 'structured', count(*), 5 from traffic
union all select 'notes.txt', 'txt', 'unstructured', count(*), 20 from conversations
union all select 'notes.md', 'md', 'unstructured', count(*), 20 from benchmark
""")
def _s09(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_statistics(spark, read_batch(spark, _batch_folder(spark, sf)))


@query("s09_ingest_totals", with_sql(PERF_SQL, _ADS_SQL, _TRAFFIC_SQL, _JOINED_SQL) + """
select 4::bigint as files, count(*) + (select count(*) from conversations) + (select count(*) from benchmark) as "rows",
       27 as columns, 6 + 20 as source_columns from joined
""")
def _s09_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_totals(read_batch(spark, _batch_folder(spark, sf)))


@query("s09_name_mapping", with_sql(PERF_SQL, _ADS_SQL) + union_sql([
    f"select '{old}' as old_name, '{new}' as new_name, count(\"{new}\") as filled from ads"
    for old, new in [("Date", "date"), ("Region", "region"), ("spend", "spend"), ("clicks", "clicks")]
]))
def _s09_names(spark: SparkSession, sf: str) -> DataFrame:
    ads = read_batch(spark, _batch_folder(spark, sf)).tables["ads.csv"]
    filled = ads.agg(*[F.count(c).alias(c) for c in ads.columns]).unpivot([], ads.columns, "old_name", "filled")
    return filled.join(F.broadcast(mapping_frame(spark, name_mapping(ads))), "old_name").select("old_name", "new_name", "filled")


@query("s11_snapshot", with_sql(PERF_SQL) + f"""
select ts::varchar as ts, order_id, line_no, part_id, supplier_id, spend, revenue from perf order by {", ".join(ORDER)} limit 5
""")
def _s11(spark: SparkSession, sf: str) -> DataFrame:
    df = perf(spark, sf, [*ORDER, "spend", "revenue"])
    return shown(snapshot(df, ORDER), 2)
