"""Medians by group: brackets that miss, groups of every kind, and no dealing of rows by group."""

import statistics

import pytest
from pyspark.sql import functions as F

from mediatally.operators import quantile
from mediatally.operators.missing import fill_medians


def _groups(spark):
    rows = [(f"g{i % 3}", float(i % 997), float(i) if i < 500 else None, None) for i in range(1000)]
    rows += [("one", 5.0, None, None), ("none", None, None, None), (None, 7.0, 7.0, None)]
    return rows, spark.createDataFrame(rows, "g string, v double, w double, x double").repartition(5)


def _expected(rows):
    found = {}
    for g in {r[0] for r in rows} - {None}:
        for i, c in enumerate("vwx", start=1):
            if known := [r[i] for r in rows if r[0] == g and r[i] is not None]:
                found[g, c] = statistics.median(known)
    return found


@pytest.mark.parametrize("low, high", [(None, None), (-5.0, -1.0), (2000.0, 3000.0), (10.0, 11.0), (499.0, 499.5)])
def test_medians_by_group_from_a_wrong_bracket(spark, monkeypatch, low, high):
    rows, df = _groups(spark)
    held = quantile._sketched_by
    wrong = lambda b: F.col(b).withField("low", F.lit(low)).withField("high", F.lit(high)).alias(b)
    if low is not None:
        monkeypatch.setattr(quantile, "_sketched_by", lambda *a: (f := held(*a)).select("g", *[wrong(b) for b in f.columns[1:]]))
    found = {(r.g, r.metric): r.median for r in quantile.medians(df, ["v", "w", "x"], ["g"]).collect()}
    assert found == _expected(rows)


def test_filling_by_group_deals_no_rows_by_group(spark):
    rows, df = _groups(spark)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = fill_medians(df, ["v", "w", "x"], ["g"])
        plan = filled._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        got = sorted(str(tuple(r)) for r in filled.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    want = _expected(rows)
    assert got == sorted(str((g, *(want.get((g, c)) if x is None else x for c, x in zip("vwx", r)))) for g, *r in rows)
