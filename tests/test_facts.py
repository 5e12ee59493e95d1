"""One scan for statistics, totals, summary and deviations; stages made once, whichever sections are asked for."""

import re

import pytest
from pyspark.sql import functions as F

from mediatally.operators.aggregate import daily, kpi_overall, kpi_overall_from, kpi_stats, summary, weekly
from mediatally.operators.anomalies import anomalies, anomaly_values
from mediatally.operators.facts import anomalies_from, daily_from, days_with_flags, stats_from, summary_from, table_facts, weekly_from
from mediatally.plans import report
from mediatally.plans.report import kpi_tables, store
from mediatally.session import staged


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


SCHEMA = "date timestamp, region string, clicks bigint, spend double, visits double, flat double"
ROWS = [(f"2024-01-{1 + i % 9:02d} 10:00:00" if i % 7 else None, f"r{i % 3}", i % 5 if i % 4 else None, 1e6 if i == 50 else i * 0.1, float("nan") if i % 6 == 0 else float(i), 0.1) for i in range(200)]


@pytest.fixture(params=["filled", "one", "empty", "nulls"])
def table(spark, request):
    rows = {"filled": ROWS, "one": ROWS[8:9], "empty": [], "nulls": [(None,) * 6] * 3}[request.param]
    df = spark.createDataFrame([(r[0], *r[1:]) for r in rows], SCHEMA.replace("timestamp", "string")).withColumn("date", F.col("date").cast("timestamp"))
    # Missing values come to the operators as nulls; facts take NaN for missing too.
    return df.repartition(5), df.withColumn("visits", F.expr("nullif(visits, double('nan'))"))


def test_sections_from_facts_equal_those_from_the_table(table):
    df, clean = table
    facts = staged(table_facts(clean), "facts")
    days = staged(days_with_flags(clean, facts), "days")
    metrics = ["clicks", "spend", "visits", "flat"]
    stats = stats_from(facts)
    assert rounded(stats) == rounded(kpi_stats(clean))
    assert rounded(kpi_overall_from(stats, metrics)) == rounded(kpi_overall(clean))
    assert summary_from(facts, clean).collect() == summary(clean).collect()
    assert daily_from(days, metrics).columns == daily(clean).columns and weekly_from(days, metrics).columns == weekly(clean).columns
    assert rounded(daily_from(days, metrics)) == rounded(daily(clean))
    assert rounded(weekly_from(days, metrics)) == rounded(weekly(clean))
    for least in (3, 50):
        assert rounded(anomaly_values(clean, ["spend", "region"], min_values=least, facts=facts)) == rounded(anomaly_values(clean, ["spend", "region"], min_values=least))
    assert rounded(anomalies_from(facts, days, metrics)) == rounded(anomalies(clean))
    assert rounded(stats_from(table_facts(df))) == rounded(stats)  # NaN is missing


def test_a_constant_is_never_flagged(spark):
    df = spark.range(100_000, numPartitions=7).select(F.lit(0.1).alias("spend"))
    facts = staged(table_facts(df), "facts")
    assert facts.where("metric = 'spend'").first().deviation == 0.0
    assert anomalies_from(facts, days_with_flags(df, facts, threshold=0.5), ["spend"]).count() == 0


def test_stages_are_made_once_for_any_sections(spark, tmp_path, monkeypatch):
    made = []
    write = report.write_stage
    monkeypatch.setattr(report, "write_stage", lambda tables, folder: made.extend(tables.items()) or write(tables, folder))
    spark.createDataFrame(ROWS[1:6] * 3, SCHEMA.replace("timestamp", "string")).withColumn("date", F.col("date").cast("timestamp")).withColumn("revenue", F.col("spend")).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    read = lambda plan: re.findall(rf"FileScan parquet .*?{tmp_path}/in", plan)
    for k, (sections, stages) in enumerate({
        ("summary",): ["facts"], ("kpi_overall", "kpi_stats"): ["facts"], ("top_performers",): ["by_dimension"],
        ("kpi_overall", "top_performers", "period_comparison", "anomalies", "summary"): ["facts", "days", "by_dimension"],
        ("correlations",): ["pairs"],
    }.items()):
        made.clear()
        stored, paths = store(df, str(tmp_path / f"stages{k}"), list(sections))
        assert [name for name, _ in made] == stages == [p.rsplit("/", 1)[1].removesuffix(".parquet") for p in paths]
        for name, table in made:  # one scan of the table each
            assert len(read(table._jdf.queryExecution().executedPlan().toString())) == 1, name
        tables = kpi_tables(df, stored=stored)
        for name in sections:  # and none for the sections
            assert not read(tables[name]._jdf.queryExecution().executedPlan().toString()), name
