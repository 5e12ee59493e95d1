"""Small sample tables and a report text with totals worked out independently of this code."""

from pathlib import Path

import pytest

from mediatally.operators.aggregate import kpi_overall
from mediatally.operators.compare import period_comparison
from mediatally.operators.documents import document_rows, extract
from mediatally.operators.merge import merge_tables
from mediatally.operators.anomalies import anomalies
from mediatally.operators.parse import parse_time_columns
from mediatally.operators.rank import top_performers
from mediatally.plans.report import run_report
from mediatally.sources.files import read_csv, read_json, read_text

DATA = Path(__file__).parent / "data"

TOTALS = {
    "campaigns.csv": {
        "total_impressions": 7_503_000, "total_clicks": 225_090, "total_conversions": 11_244, "total_spend": 112_545.0, "total_revenue": 281_350.0,
        "overall_ctr": 3.0, "overall_cpc": 0.5, "overall_cpm": 15.0, "overall_conversion_rate": 4.9953, "overall_cpa": 10.0093, "overall_roas": 2.4999,
    },
    "channels.csv": {
        "total_impressions": 7_387_000, "total_clicks": 301_820, "total_conversions": 18_888, "total_spend": 253_410.0, "total_revenue": 1_924_300.0,
        "overall_ctr": 4.0858, "overall_cpc": 0.8396, "overall_cpm": 34.3049, "overall_conversion_rate": 6.2580, "overall_cpa": 13.4165, "overall_roas": 7.5936,
    },
}
REGIONS = {
    "campaigns.csv": [("West", 94_387.5), ("Northeast", 75_100.0), ("Southeast", 61_087.5), ("Midwest", 50_775.0)],
    "channels.csv": [("North America", 993_800.0), ("Europe", 469_700.0), ("Asia Pacific", 460_800.0)],
}
PERIODS = {"campaigns.csv": ("2024-01-07", 110_050.0, 171_300.0, 55.66), "channels.csv": ("2024-01-11", 792_900.0, 1_131_400.0, 42.69)}
ANOMALIES = {"campaigns.csv": (2, 3.57), "channels.csv": (6, 7.14)}


@pytest.mark.parametrize("name", sorted(TOTALS))
def test_totals_of_a_sample(spark, name):
    df = parse_time_columns(read_csv(spark, str(DATA / name)))
    found = {r.kpi: r.value for r in kpi_overall(df).collect()}
    assert {k: found[k] for k in TOTALS[name]} == TOTALS[name]
    top = top_performers(df).where("dimension = 'region' and metric = 'revenue'").orderBy("rank").collect()
    assert [(r.name, r.value) for r in top] == REGIONS[name]
    row = period_comparison(df).where("metric = 'revenue'").first()
    assert (str(row.mid_date), row.period1_total, row.period2_total, row.change_pct) == PERIODS[name]
    odd = anomalies(df).where("metric = 'revenue'").first()
    assert (odd["count"], round(odd.percentage, 2)) == ANOMALIES[name]


def test_sample_traffic_and_its_join(spark):
    traffic = read_json(spark, str(DATA / "traffic.json"))
    assert traffic.count() == 16
    assert traffic.selectExpr("sum(visits)", "sum(unique_visitors)").first() == (100_140, 68_700)
    ads = read_csv(spark, str(DATA / "campaigns.csv"))
    merged = merge_tables([ads, traffic])
    assert merged.count() == 56 and merged.where("visits is null").count() == 40 and merged.where("spend is null").count() == 0


def test_sample_report_text(spark):
    text = read_text(spark, str(DATA / "weekly.txt"))
    row = document_rows(text).first()
    assert (row.conversions_total, row.conversions_count) == (8450.0, 1)
    assert row.impressions_total is None and row.clicks_total is None and row.visitors_total is None and row.large_numbers_total is None
    assert row.regions_list == "Northeast, Southeast, West" and row.dates_list == "January 21, 2024"
    assert (row.campaigns_count, row.products_count, row.companies_count) == (5, 0, 0)
    found = extract(text).first()
    assert (len(found.metrics.ctr), len(found.metrics.percentages), len(found.metrics.dollar_amounts)) == (4, 12, 6)


def test_report_over_the_samples(spark, tmp_path):
    report = run_report(spark, str(DATA), str(tmp_path / "out"), scope="data_source_type")
    names = {Path(p).stem for p in report.paths}
    assert {
        "insights", "digest", "kpi_cards", "ingest_statistics", "name_mapping", "document_summary", "failed_documents", "missing_profile",
        "transform_report", "correlations", "correlation_size", "daily", "weekly", "by_region", "segmentation", "correlation_heatmap",
    } <= names
    assert spark.read.parquet(str(tmp_path / "out/text/insights.parquet")).count() == 12


def test_report_reads_its_table_few_times(spark, tmp_path, monkeypatch):
    from mediatally.plans import report

    reads = {}

    def counted(tables, folder):
        for name, df in tables.items():
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            files = [p for p in df.inputFiles() if "transformed_data" in p]
            reads[name] = plan.count("Relation [") if files else 0
        return write(tables, folder)

    write = report.write_stage
    monkeypatch.setattr(report, "write_stage", counted)
    run_report(spark, str(DATA), str(tmp_path / "out"), order_by=["date"], scope="data_source_type")
    table = {k: n for k, n in reads.items() if n}
    for name in ("daily", "weekly", "kpi_stats", "summary", "anomalies", "kpi_overall", "top_performers", "period_comparison", "correlations", "weather_traffic", "correlation_heatmap", "daily_performance", "segmentation"):
        assert name not in table, name
    assert set(table) <= {"facts", "days", "by_dimension", "pairs", "anomaly_values", "snapshot", "transform_report"}
