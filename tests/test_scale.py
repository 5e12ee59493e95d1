"""Plans and edge cases that matter at scale: growth of a merge, scans of a report, hot keys, zones, odd input."""

import json

import pytest
from pyspark.sql import functions as F

from mediatally.functions.patterns import counted_matches
from mediatally.operators.aggregate import exact_totals
from mediatally.operators.documents import document_rows
from mediatally.operators.fill import fill_times
from mediatally.operators.merge import merge_tables
from mediatally.operators.missing import fill_missing
from mediatally.operators.parse import parse_time_columns, to_number
from mediatally.plans.report import transform
from mediatally.sources.batch import list_entries, read_batch
from mediatally.sources.files import read_csv, read_json
from mediatally.streaming.daily import daily_kpis, latest_days, update_days


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan") + df._jdf.queryExecution().executedPlan().toString().count("LocalTableScan")


def test_merge_grows_linearly(spark):
    tables = [spark.createDataFrame([(d, f"r{d % 2}", float(i)) for d in range(6)], f"date int, region string, m{i} double") for i in range(10)]
    counts = [scans(merge_tables(tables[:n])) for n in (3, 5, 10)]
    assert counts[2] == counts[1] <= 4
    assert merge_tables(tables).count() == 6


def test_merge_with_a_hot_null_key(spark):
    left = spark.createDataFrame([(None if i % 3 else i, i) for i in range(60)], "id int, a int")
    right = spark.createDataFrame([(None, 1), (3, 2), (1000, 3)], "id int, b int")
    merged = merge_tables([left, right, right.withColumnRenamed("b", "c")])
    assert merged.where("id is null").count() == 40 and merged.where("id = 1000").count() == 1 and merged.count() == 61


def test_missing_tokens_quoted_breaks_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('d,spend,temp,note,flag\n2024-01-01,1.5,20,"one\ntwo",true\n2024-01-02,NA,N/A,"say ""hi""",false\n2024-01-03,3.5,22,None,\n')
    df = read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"d": "date", "spend": "double", "temp": "bigint", "note": "string", "flag": "boolean"}
    rows = df.orderBy("d").collect()
    assert [r.spend for r in rows] == [1.5, None, 3.5] and [r.note for r in rows] == ["one\ntwo", 'say "hi"', None]
    given = read_csv(spark, str(tmp_path / "a.csv"), "d date, spend double, temp int, note string, flag boolean", multiline=True)
    assert given.where("temp is null").count() == 1


def test_latin_file_with_a_blank_and_brackets(spark, tmp_path):
    (tmp_path / "c d [1].csv").write_bytes("name,é\nnoël,1\nÃ©,2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("name,é\nÃ©,3\n".encode())
    entries = list_entries(spark, str(tmp_path))
    assert [e.name for e in entries] == ["b.csv", "c d [1].csv"]
    batch = read_batch(spark, str(tmp_path))
    found = sorted((r[0], r[1]) for e in entries for r in batch.tables[e.name].collect())
    assert found == [("noël", 1), ("Ã©", 2), ("Ã©", 3)]
    assert batch.tables["b.csv"].columns == ["name", "é"]


def test_json_records_keep_a_data_field(spark, tmp_path):
    (tmp_path / "f.json").write_text("\n " + json.dumps([{"id": 1, "data": {"x": 1}}]))
    assert read_json(spark, str(tmp_path / "f.json")).select("id", "data.x").first() == (1, 1)
    (tmp_path / "g.json").write_text(json.dumps({"id": 1, "data": [{"x": 1}, {"x": 2}]}))
    assert sorted(r.x for r in read_json(spark, str(tmp_path / "g.json")).collect()) == [1, 2]


def test_day_first_and_nan(spark):
    df = spark.createDataFrame([("13/01/2024", "02/01/2024"), ("02/01/2024", "01/14/2024")], "created_date string, updated_date string")
    assert [str(r.created_date.date()) for r in parse_time_columns(df).collect()] == ["2024-01-13", "2024-01-02"]
    assert [str(r.updated_date.date()) for r in parse_time_columns(df).collect()] == ["2024-02-01", "2024-01-14"]
    assert spark.range(1).select(to_number(F.lit("NaN")).alias("v")).first().v is None


def test_fill_without_tag_and_by_its_own_order(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), ("2024-01-02", None, None), ("2024-01-03", 3.0, "a")], "date string, spend double, region string")
    out = transform(df, scope="data_source_type")
    assert sorted(str(r.date)[:10] for r in out.collect()) == ["2024-01-02", "2024-01-02", "2024-01-03"]
    assert sorted(r.spend for r in out.collect()) == [1.0, 2.0, 3.0] and out.where("region is null").count() == 0
    named = fill_missing(parse_time_columns(df), order_by=["date"])
    assert named.where("date is null").count() == 0


def test_fill_splits_a_hot_key(spark):
    df = spark.range(900).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 2 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("at"))
    assert fill_times(df, ["at"], ["k"], ranges=16).where("at is null").count() == 0


def test_exact_totals_above_doubles(spark):
    df = spark.createDataFrame([(2**53 + 1, 0.1)] * 3, "impressions bigint, spend double")
    assert {r.metric: str(r.total) for r in exact_totals(df).collect()} == {"impressions": "27021597764222979.00", "spend": "0.30"}


def test_digits_of_other_scripts(spark):
    df = spark.createDataFrame([("١٢ clicks and 3 clicks",)], "text string")
    assert df.select(counted_matches(F.col("text"), "clicks").alias("v")).first().v == [12.0, 3.0]


def test_each_text_pattern_runs_once(spark):
    df = spark.createDataFrame([("a", "12 clicks")], "source_file string, text string")
    plan = document_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 11


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_stream_days_in_any_zone(spark, tmp_path, zone):
    rows = spark.createDataFrame([("2024-01-02 12:00:00", 1.0), ("2024-01-02 23:30:00", 2.0), ("2024-01-04 00:10:00", 4.0)], "ts string, spend double")
    rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "spend").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        stream = spark.readStream.schema("ts timestamp_ntz, spend double").parquet(str(tmp_path / "in"))
        update_days(daily_kpis(stream, "ts", ["spend"]), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
        found = {str(r.date): r.spend_sum for r in latest_days(spark, str(tmp_path / "out")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == {"2024-01-02": 3.0, "2024-01-04": 4.0}
