"""Edge cases on small inline tables, checked against values worked out by hand or by brute force."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from mediatally.functions.markdown import strip_markdown
from mediatally.functions.numbers import half_even, settled
from mediatally.operators import narrative
from mediatally.operators.aggregate import kpi_overall, kpi_stats, summary, weekly
from mediatally.operators.anomalies import anomalies, anomaly_values
from mediatally.operators.compare import period_comparison
from mediatally.operators.correlate import correlation_pairs, significant_pairs
from mediatally.operators.derive import derive_metrics
from mediatally.operators.documents import document_rows, document_summary, extract, failed_documents
from mediatally.operators.fill import fill_times
from mediatally.operators.merge import merge_sources, merge_tables, outer_join
from mediatally.operators.missing import fill_missing, fill_modes, medians, modes
from mediatally.operators.names import normalised_names
from mediatally.operators.parse import coerce_numeric, parse_time_columns
from mediatally.operators.quantile import medians as exact_medians
from mediatally.operators.rank import top_performers, top_segments
from mediatally.operators.responses import parse_responses
from mediatally.operators.roles import (
    column_roles, dimension_columns, metric_columns, segment_column, time_named_columns,
)
from mediatally.operators.series import daily_series, trend_lines


def day(n: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_names_collide_and_clean_up():
    assert normalised_names(["Total Spend ($)", "total-spend", " Date ", "A..B--c", "###"]) == [
        "total_spend", "total_spend_2", "date", "a_b_c", "column",
    ]


def test_roles(spark):
    df = spark.createDataFrame([], "updated_by string, generated_date string, spend_date string, ts timestamp_ntz, "
                                   "sales_region string, ok boolean, n int, note string")
    assert time_named_columns(df) == ["updated_by"]
    assert dict(column_roles(df)) == {
        "updated_by": "text", "generated_date": "text", "spend_date": "text", "ts": "time",
        "sales_region": "dimension", "ok": "other", "n": "metric", "note": "text",
    }
    assert segment_column(df) == "sales_region" and dimension_columns(df) == ["sales_region"] and metric_columns(df) == ["n"]


def test_mixed_date_layouts_and_bad_cells(spark):
    df = spark.createDataFrame([("2024-01-01",), ("01/02/2024",), ("x",), (None,), ("Jan 5, 2024",)], "date string")
    got = [r.date for r in parse_time_columns(df).collect()]
    assert got == [day(0), day(1), None, None, day(4)]


def test_numbers_that_are_none(spark):
    df = spark.createDataFrame([("1,000",), (" 12.5 ",), ("1d",), ("abc",), ("1e3",)], "spend string")
    assert [r.spend for r in coerce_numeric(df).collect()] == [None, 12.5, None, None, 1000.0]


def test_half_even(spark):
    df = spark.createDataFrame([(0.12345,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(half_even(F.col("x"), 4)).collect()][0] == 0.1234
    assert [r[0] for r in df.select(half_even(F.col("x"), 0)).collect()][1:] == [2.0, -0.0]
    noisy = spark.createDataFrame([(0.125 + 1e-12,), (0.125 - 1e-12,)], "x double")
    assert {r[0] for r in noisy.select(settled(F.col("x"), 2)).collect()} == {0.12}


def test_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0, 5.0), (1, 3, 1, 2.0, 5.0)],
                               "clicks int, impressions int, conversions int, spend double, revenue double")
    first, second = derive_metrics(df).collect()
    assert [first[c] for c in ("ctr", "cpc", "cpm", "conversion_rate", "cpa", "roas")] == [None] * 6
    assert (second.ctr, second.cpm, second.roas) == (33.3333, 666.6667, 2.5)
    assert "engagement_rate" not in derive_metrics(df).columns


@pytest.mark.parametrize("seed", range(4))
def test_medians_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: 10 ** rng.uniform(-9, 9), lambda: 7.0]
    rows = [tuple(d() if rng.random() > 0.2 else None for d in draw) + (None,) for _ in range(rng.choice([1, 2, 301, 1000]))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    found = values(exact_medians(df, df.columns), "metric", "median")
    for i, c in enumerate(df.columns):
        known = [r[i] for r in rows if r[i] is not None]
        assert found.get(c) == (statistics.median(known) if known else None)


def test_median_with_one_value_in_a_third_of_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    data = [5.0 if i % 3 == 0 else float(i) for i in range(9000)]
    assert medians(df, ["v"]).first()["median"] == statistics.median(data)


def test_modes_ties_and_unknown(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "s string, t string")
    assert values(modes(df, ["s", "t"]), "column", "mode") == {"s": "a"}
    filled = fill_modes(df).collect()
    assert filled[-1].s in ("a", "b") and {r.t for r in filled} == {"Unknown"}
    assert sorted(r.s for r in filled) == ["a", "a", "a", "b", "b"]


def test_times_fill_forward_then_backward(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else "x", day(rng.randint(0, 50)) if rng.random() > 0.6 and i > 3 else None) for i in range(400)]
    expected, last = [], next(r[2] for r in rows if r[2])
    for _, _, t in rows:
        last = t or last
        expected.append(last)
    df = spark.createDataFrame(rows, "i int, k string, t timestamp_ntz").repartition(7)
    for ranges in (2, 16, 4096):
        got = {r.i: r.t for r in fill_times(df, ["t"], ["i"], ranges).collect()}
        assert [got[i] for i in range(400)] == expected
    empty = fill_times(df.withColumn("t", F.lit(None).cast("timestamp_ntz")), ["t"], ["i"])
    assert empty.where("t is not null").count() == 0 and empty.count() == 400


def test_times_fill_with_one_leading_key_in_a_third_of_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("d"), F.col("id").alias("n"),
        F.when(F.col("id") % 5 == 0, F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz")).alias("t"),
    )
    rows = sorted(((r.d, r.n, r.t) for r in df.collect()), key=lambda r: r[:2])
    last = next(t for _, _, t in rows if t)
    expected = {}
    for d, n, t in rows:
        last = t or last
        expected[n] = last
    assert {r.n: r.t for r in fill_times(df, ["t"], ["d", "n"], 64).collect()} == expected


def test_scoped_fill_keeps_foreign_metrics_null(spark):
    ads = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, None)], "spend double, region string")
    notes = spark.createDataFrame([(10.0,), (20.0,)], "chars_total double")
    both = merge_sources(ads, notes)
    scoped = fill_missing(both, scope="data_source_type")
    assert scoped.where("data_source_type = 'unstructured' and spend is not null").count() == 0
    assert sorted(r.spend for r in scoped.where("spend is not null").collect()) == [1.0, 2.0, 3.0]
    table = fill_missing(both)
    assert table.where("spend is null or chars_total is null").count() == 0
    assert merge_sources(ads, None) is ads and merge_sources(None, notes) is notes


def test_outer_join_null_and_repeated_keys(spark):
    left = spark.createDataFrame([("x", None, 1), ("x", "r", 2), ("x", "r", 3), ("y", "r", 4)], "date string, region string, v int")
    right = spark.createDataFrame([("x", None, 9, 10), ("x", "r", 9, 20), ("x", "r", 9, 30), ("z", "r", 9, 40)],
                                  "date string, region string, v int, w int")
    got = sorted(((r.date, r.region, r.v, r.w) for r in outer_join(left, right, ["date", "region"]).collect()), key=repr)
    assert got == sorted([
        ("x", None, 1, 10), ("x", "r", 2, 20), ("x", "r", 2, 30), ("x", "r", 3, 20), ("x", "r", 3, 30),
        ("y", "r", 4, None), ("z", "r", None, 40),
    ], key=repr)


@pytest.mark.parametrize("hot", ["left", "right"])
def test_outer_join_with_a_hot_key(spark, hot):
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("id")
    many = spark.range(3000).select(key, F.col("id").alias("big"))
    few = spark.range(0, 6000, 2).select("id", F.col("id").alias("small"))
    pair = (many, few) if hot == "left" else (few, many)
    got = outer_join(*pair, ["id"])
    keys = [0 if i % 3 == 0 else i for i in range(3000)]
    evens = set(range(0, 6000, 2))
    matches = sum(k in evens for k in keys)
    expected = (len(keys) + len(evens - set(keys)), matches)
    assert (got.count(), got.where("big is not null and small is not null").count()) == expected


def test_tables_without_shared_key_are_united(spark):
    a = spark.createDataFrame([(1, "x")], "Cost int, name string")
    b = spark.createDataFrame([(2.5, 7)], "cost double, name int")
    assert sorted((r.cost, r.name) for r in merge_tables([a, b]).collect()) == [(1.0, "x"), (2.5, "7")]


def test_weeks_at_year_end(spark):
    rows = [(dt.datetime(2024, 12, 29) + dt.timedelta(days=i), 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    assert {(r.year, r.week): r.v_sum for r in weekly(df).collect()} == {(2024, 52): 1.0, (2024, 1): 2.0, (2025, 1): 5.0}
    assert {(r.year, r.week): r.v_sum for r in weekly(df, iso_year=True).collect()} == {(2024, 52): 1.0, (2025, 1): 7.0}


def test_period_needs_two_days_and_handles_zero(spark):
    one = spark.createDataFrame([(day(0), 1.0), (day(1), 1.0)], "ts timestamp_ntz, v double")
    assert period_comparison(one).count() == 0
    df = spark.createDataFrame([(day(0), 0.0, 0.0), (day(3), 5.0, 0.0)], "ts timestamp_ntz, v double, z double")
    got = {r.metric: (r.period1_total, r.period2_total, r.change_pct, str(r.mid_date)) for r in period_comparison(df).collect()}
    assert got == {"v": (0.0, 5.0, 100.0, "2024-01-02"), "z": (0.0, 0.0, 0.0, "2024-01-02")}


def test_constant_and_missing_metrics(spark):
    rows = [(0.1, float(i), None, float(i * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "flat double, up double, gone double, square double")
    pairs = {(r.column1, r.column2): r.correlation for r in correlation_pairs(df).where("i < j").collect()}
    expected = statistics.correlation(range(20), [i * i for i in range(20)])
    assert pairs[("flat", "up")] is None and pairs[("up", "square")] == pytest.approx(expected)
    assert all(v is None for k, v in pairs.items() if "gone" in k)
    best = significant_pairs(df).collect()
    assert [(r.column1, r.column2, r.strength, r.rank) for r in best] == [("up", "square", "strong", 1)]
    stats = {r.metric: (r.total, r.avg) for r in kpi_stats(df).collect()}
    assert stats["gone"] == (0.0, None)


def test_pairwise_complete_correlation(spark):
    rng = random.Random(3)
    rows = [tuple(rng.gauss(1e6, 1) if rng.random() > 0.3 else None for _ in range(3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(6)
    for r in correlation_pairs(df).where("i < j").collect():
        both = [(x[r.i], x[r.j]) for x in rows if x[r.i] is not None and x[r.j] is not None]
        assert r.correlation == pytest.approx(statistics.correlation(*zip(*both)), abs=1e-9)


def test_anomalies_skip_constant_and_short_metrics(spark):
    rows = [(1.0, None if i > 1 else float(i), 100.0 if i == 13 else float(i % 3)) for i in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, flat double, short double, spiky double")
    metrics = ["flat", "short", "spiky"]
    got = anomalies(df, metrics).collect()
    assert [(r.metric, r["count"], r.percentage) for r in got] == [("spiky", 1, 2.5)]
    assert got[0].std == round(statistics.stdev(r[2] for r in rows), 2)
    assert [(r.metric, r.pos, r.value) for r in anomaly_values(df, ["i"], metrics).collect()] == [("spiky", 1, 100.0)]
    assert {r.metric for r in anomalies(df, metrics, threshold=0.5).collect()} == {"spiky"}
    assert {r.metric for r in anomaly_values(df, ["i"], metrics, threshold=0.5).collect()} == {"spiky"}


def test_top_lists_ties_and_single_values(spark):
    df = spark.createDataFrame([("b", "only", 1.0), ("a", "only", 1.0), ("c", "only", 0.5)], "region string, channel string, revenue double")
    got = [(r.dimension, r.rank, r.name) for r in top_performers(df, n=2).orderBy("rank").collect()]
    assert got == [("region", 1, "a"), ("region", 2, "b")]
    assert top_performers(df, n=1).count() == 1
    shares = [(r.name, r.share_pct) for r in top_segments(df, n=2).orderBy("rank").collect()]
    assert shares == [("a", 50.0), ("b", 50.0)]


def test_ranking_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("string").alias("region"), F.col("id").cast("double").alias("revenue"))
    plan = top_performers(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_trend_needs_three_days(spark):
    rows = [(day(i), float(2 * i + 1)) for i in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, clicks double")
    line = trend_lines(daily_series(df)).first()
    assert (round(line.slope, 9), round(line.intercept, 9), line.points) == (2.0, 1.0, 5)
    assert trend_lines(daily_series(df.limit(2))).count() == 0


def test_overall_ratio_zero_without_denominator(spark):
    df = spark.createDataFrame([(0, 0, 5.0)], "clicks int, impressions int, spend double")
    got = values(kpi_overall(df), "kpi", "value")
    assert got == {"total_clicks": 0.0, "total_impressions": 0.0, "total_spend": 5.0, "overall_ctr": 0.0, "overall_cpc": 0.0, "overall_cpm": 0.0}
    no_views = spark.createDataFrame([(3,)], "clicks int")
    assert kpi_overall(no_views).count() == 0


def test_summary_without_time(spark):
    got = summary(spark.createDataFrame([(1, None)], "a int, b string")).first()
    assert (got.total_rows, got.missing_values, got.missing_percentage, got.total_days) == (1, 1, 50.0, None)


def test_text_extraction(spark):
    text = (
        "CTR: 3.1% and 12 % of $1,234.50; 2.5M reach, 3K calls, 1.2 million no.\n"
        "1,000 impressions\n2,500 views, 40 Clicks, 7 conversions, 9 users\nImpressions: 4,567,000\n"
        "Campaign: \"Winter Sale\" ran on 1/15/2024 and 2024-02-01, January 5, 2024; west and USA, 'Spring offer'"
    )
    df = spark.createDataFrame([("f", text), ("empty", "nothing here")], "source_file string, text string")
    full, empty = extract(df).collect()
    m, e = full.metrics, full.entities
    assert m.percentages == ["3.1", "12"] and m.dollar_amounts == ["1,234.50"] and m.ctr == ["3.1"]
    assert m.large_numbers == [2.5e6, 3000.0] and m.impressions == [1000.0, 2500.0]
    assert (m.clicks, m.conversions, m.visitors) == ([40.0], [7.0], [9.0])
    assert m.dates == ["1/15/2024", "2024-02-01"]
    assert e.campaigns == ["Spring offer", "Winter Sale"] and e.regions == ["USA", "West"]
    assert e.dates == ["1/15/2024", "2024-02-01", "January 5, 2024"]
    assert all(v is None for v in empty.metrics) and all(v == [] for v in empty.entities)
    row = document_rows(df).first()
    assert (row.impressions_total, row.impressions_count, row.regions_list, row.products_count) == (3500.0, 2, "USA, West", 0)


def test_document_summary_counts_failures(spark):
    df = spark.createDataFrame([("a", "abc"), ("b", None)], "source_file string, text string")
    assert tuple(document_summary(df).first()) == (1, 1, 3)
    assert [r.file for r in failed_documents(df).collect()] == ["b"]


def test_markdown(spark):
    text = "# Head\n**bold** and *it* [link](http://x) ![](a.png)![alt](b.png)\n```\ncode\n```\nuse `x`  "
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(strip_markdown(F.col("t"))).first()[0] == "Head\nbold and it link !alt\n\nuse x"


def test_response_sections(spark):
    text = "Executive Summary\nGood week.\n- up 5%\n## Key Highlights\n1. Reach\n2) Clicks\n# skip\nIssues\n- cost\nRecommendations\n* Test"
    rows = spark.createDataFrame([(1, text), (2, "Key highlights\n- lost\nRecommendations\n- kept")], "id int, text string")
    got = sorted((r.id, r.section, r.pos, r.text) for r in parse_responses(rows, ["id"]).collect())
    assert got == [
        (1, "executive_summary", 1, "Good week. up 5%"), (1, "key_highlights", 1, "Reach"), (1, "key_highlights", 2, "Clicks"),
        (1, "performance_issues", 1, "cost"), (1, "recommendations", 1, "Test"), (2, "recommendations", 1, "kept"),
    ]


def test_insight_padding(spark):
    kpis = spark.createDataFrame([("total_clicks", 1234.0)], "kpi string, value double")
    top = spark.createDataFrame([], "dimension string, metric string, rank int, name string, value double")
    comparison = spark.createDataFrame([("clicks", -25.0), ("spend", -10.0)], "metric string, change_pct double")
    flagged = spark.createDataFrame([("spend", 3, 6.25), ("clicks", 1, 5.0)], "metric string, count int, percentage double")
    facts = summary(spark.createDataFrame([(1,)], "clicks int"))
    rows = narrative.insights(kpis, top, comparison, flagged, facts, ["region"], ["clicks", "spend"]).collect()
    text = {s: [r.text for r in sorted(rows, key=lambda r: r.pos) if r.section == s] for s in {r.section for r in rows}}
    assert text["executive_summary"] == ["This report analyzes 1 data records spanning N/A to N/A. "]
    assert text["key_highlights"] == ["Generated 1,234 total clicks"] + [narrative.HIGHLIGHT_PADDING] * 4
    assert text["performance_issues"] == [
        "Clicks decreased by 25.0% compared to previous period", "Detected 3 anomalies in spend (6.2% of data)",
        narrative.ISSUE_PADDING,
    ]
    assert text["recommendations"] == narrative.RECOMMENDATIONS
