"""How often an expensive table is evaluated: once, whatever reads it afterwards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediatally.operators.missing import fill_medians, fill_missing
from workload import cleaning, files

ROWS = 600


@pytest.fixture()
def counted(spark):
    """A table that counts the rows it is evaluated for."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    ids = spark.range(ROWS).mapInPandas(run, "id bigint")
    at = F.timestamp_seconds(F.col("id") * 6000).cast("timestamp_ntz")
    table = ids.select(
        F.when(F.col("id") % 13 != 0, at).alias("ts"), "id", *[F.concat(F.lit(c), F.col("id") % 3).alias(c) for c in files.DIMENSIONS],
        F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("spend"), F.col("id").cast("double").alias("revenue"),
    )
    return table, seen


def test_median_fill_evaluates_its_input_once(counted):
    df, seen = counted
    filled = fill_medians(df.select("spend", "revenue")).collect()
    known = sorted(i for i in range(ROWS) if i % 7)
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert seen.value == ROWS and sorted(r.spend for r in filled) == sorted(i if i % 7 else middle for i in range(ROWS))


def test_fill_by_type_evaluates_its_input_once(counted):
    df, seen = counted
    filled = fill_missing(df, ["id"]).collect()
    assert seen.value == ROWS and len(filled) == ROWS and all(r.ts and r.spend is not None for r in filled)
    last = {r.id: r.ts for r in filled}
    assert last[13] == last[12] and last[0] == last[1] == dt.datetime(1970, 1, 1, 1, 40)


def test_stage_tables_evaluate_the_view_once(spark, counted, monkeypatch):
    df, seen = counted
    monkeypatch.setattr(files, "perf", lambda spark, sf, columns: df.select(*columns))
    found = {r.name: (r.rows, r.spend) for r in files._s08(spark, "").collect()}
    spend = float(sum(i for i in range(ROWS) if i % 7))
    assert seen.value == ROWS and all(found[f"by_{d}"] == (3, spend) for d in files.DIMENSIONS)


def test_transform_report_evaluates_the_view_once(spark, counted, monkeypatch):
    df, seen = counted
    table = df.select("ts", *[F.col("id").alias(c) for c in cleaning.ROW_IDS], "campaign", "spend", "revenue")
    monkeypatch.setattr(cleaning, "rough", lambda spark, sf: table)
    found = {r.item: r.value for r in cleaning._d09(spark, "").collect()}
    empty = sum(i % 13 == 0 for i in range(ROWS)) + sum(i % 7 == 0 for i in range(ROWS))
    assert seen.value == ROWS and found["rows"] == str(ROWS) and found["missing_values_handled"] == str(empty)
