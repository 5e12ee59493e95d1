"""Readers, batches, the whole report and the streams, on small files."""

import gzip
import json

import pytest

from mediatally.operators.names import normalise_names
from mediatally.plans.report import run_report
from mediatally.sources.batch import ingest_statistics, list_entries, read_batch
from mediatally.sources.files import LISTING_TASKS, read_csv, read_json, read_markdown, read_text
from mediatally.streaming.daily import append_rows, arriving_csv
from workload.files import _write_files


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\ncafé,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("name,n\nnoël,2\n", encoding="latin-1")
    got = read_csv(spark, str(tmp_path / "*.csv"))
    assert sorted((r.name, r.n) for r in got.collect()) == [("café", 1), ("noël", 2)]


def test_odd_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Unit.Price %, Total `x`,id\n1.5,NaN,1\n")
    got = normalise_names(read_csv(spark, str(tmp_path / "a.csv")))
    assert got.columns == ["unit_price", "total_x", "id"] and tuple(got.first()) == (1.5, None, 1)


def test_text_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("café\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("noël\nzwei", encoding="latin-1")
    assert sorted(tuple(r) for r in read_text(spark, str(tmp_path)).collect()) == [("a.txt", "café\n"), ("b.txt", "noël\nzwei")]


def test_markdown_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\n**b** `c`\n")
    assert read_markdown(spark, str(tmp_path)).first().text == "Title\n\nb c"


@pytest.mark.parametrize("content, expected", [
    ([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], [(1, "x"), (2, "y")]),
    ({"data": [{"a": 1, "b": "x"}], "other": 3}, [(1, "x")]),
    ({"data": {"a": [1, 2], "b": ["x", "y"]}}, [(1, "x"), (2, "y")]),
    ({"a": 1, "b": "x"}, [(1, "x")]),
])
def test_json_shapes(spark, tmp_path, content, expected):
    (tmp_path / "f.json").write_text(json.dumps(content, indent=1))
    got = read_json(spark, str(tmp_path / "f.json"))
    assert sorted((r.a, r.b) for r in got.collect()) == expected


def test_json_scalar_is_refused(spark, tmp_path):
    (tmp_path / "f.json").write_text("5")
    with pytest.raises(ValueError):
        read_json(spark, str(tmp_path / "f.json"))


@pytest.fixture
def batch_folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ["Date,Campaign Name,Region,Impressions,Clicks,Conversions,Spend,Revenue"]
    for d in range(1, 11):
        for i, region in enumerate(("West", "Midwest")):
            clicks = "" if d == 4 else 10 * d + i
            lines.append(f"2024-01-{d:02d},C{i},{region},{1000 * d},{clicks},{d},{d * 1.5},{400 if d == 10 else d * 4}")
    (folder / "ads.csv").write_text("\n".join(lines) + "\n")
    traffic = [{"date": f"2024-01-{d:02d}", "region": "West", "visits": 5 * d, "unique_visitors": d} for d in range(1, 5)]
    (folder / "traffic.json").write_text(json.dumps({"data": traffic}))
    (folder / "note.txt").write_text("Seen 1,200 clicks in the West, campaign: Winter, 3%")
    (folder / "other.bin").write_text("ignored")
    return str(folder)


def test_batch_entries_and_statistics(spark, batch_folder):
    assert [(e.name, e.category) for e in list_entries(spark, batch_folder)] == [
        ("ads.csv", "structured"), ("traffic.json", "structured"), ("note.txt", "unstructured"),
    ]
    batch = read_batch(spark, batch_folder)
    assert {(r.filename, r.rows) for r in ingest_statistics(spark, batch).collect()} == {("ads.csv", 20), ("traffic.json", 4), ("note.txt", 1)}
    assert ("Campaign Name", "campaign_name") in batch.mapping
    assert batch.table.count() == 21 and batch.structured.where("visits is not null").count() == 4


def test_whole_report(spark, batch_folder, tmp_path):
    report = run_report(spark, batch_folder, str(tmp_path / "out"), ["source_file", "region", "campaign_name", "revenue"], "data_source_type")
    names = {p.removeprefix(str(tmp_path / "out") + "/") for p in report.paths}
    assert {
        "ingested.parquet", "transformed_data.parquet", "aggregations/daily.parquet", "aggregations/by_region.parquet",
        "kpis/kpi_overall.parquet", "kpis/top_performers.parquet", "kpis/anomaly_values.parquet",
        "charts/daily_performance.parquet", "charts/correlation_heatmap.parquet", "text/insights.parquet",
    } <= names
    kpis = {r.kpi: r.value for r in spark.read.parquet(str(tmp_path / "out/kpis/kpi_overall.parquet")).collect()}
    assert kpis["total_impressions"] == 110000.0 and kpis["total_revenue"] == 2 * (4 * 45 + 400)
    texts = spark.read.parquet(str(tmp_path / "out/text/insights.parquet"))
    assert texts.groupBy("section").count().count() == 4
    assert "ctr" in report.table.columns and report.table.where("clicks is null").count() == 1


def test_stream_appends_each_file_once(spark, tmp_path):
    source, target, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    schema = "`Start Date` string, Clicks string, Impressions string"
    for n, content in enumerate(["1/2/2024,3,100\n", "x,0,0\n"]):
        (source / f"{n}.csv").write_text("Start Date,Clicks,Impressions\n" + content)
        append_rows(arriving_csv(spark, str(source), schema, 1), target, progress).awaitTermination()
    got = sorted((str(r.start_date), r.clicks, r.ctr) for r in spark.read.parquet(target).collect())
    assert got == [("2024-01-02 00:00:00", 3.0, 3.0), ("None", 0.0, None)]


def test_a_file_for_each_text_is_written_by_many_tasks(spark, tmp_path):
    texts = [f"text {i}" for i in range(1001)]
    one_task = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    _write_files(one_task, str(tmp_path / "notes.txt"))
    tasks = [p.name.split("-")[1] for p in (tmp_path / "notes.txt").glob("part-*.txt")]
    assert len(tasks) == 1001 and len(set(tasks)) == 6 and max(map(tasks.count, tasks)) <= 200
    assert sorted(r.text for r in read_text(spark, str(tmp_path / "notes.txt")).collect()) == sorted(f"{t}\n" for t in texts)
    _write_files(one_task.limit(0), str(tmp_path / "none.txt"))
    assert len(list((tmp_path / "none.txt").glob("part-*.txt"))) == 1  # as Spark writes an empty table


def test_a_file_for_each_text_is_written_without_processes_of_its_own(spark, tmp_path):
    texts = ["é one", "", None, "two\r\nlines", "é one", *map(str, range(500))]
    few = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    _write_files(few, f"file://{tmp_path}/notes in it.txt")
    found = [p.read_bytes() for p in (tmp_path / "notes in it.txt").iterdir() if p.name.startswith("part-")]
    assert sorted(found) == sorted(f"{t or ''}\n".encode() for t in texts)
    assert {p.suffix for p in (tmp_path / "notes in it.txt").iterdir()} == {".txt"}  # no checksums, nothing left over
    few.write.option("maxRecordsPerFile", 1).text(str(tmp_path / "spark.txt"))
    both = [sorted(r.text for r in read_text(spark, str(tmp_path / n)).collect()) for n in ("notes in it.txt", "spark.txt")]
    assert both[0] == both[1] and len(both[0]) == 505


def test_small_files_are_read_as_bytes_and_packed_ones_unpacked(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("noël\r\n".encode("latin-1"))
    (tmp_path / "b.md").write_bytes("\ufeffcafé".encode())
    (tmp_path / "none.txt").write_bytes(b"")
    plain = read_text(spark, str(tmp_path))
    assert sorted(tuple(r) for r in plain.collect()) == [("a.txt", "noël\r\n"), ("b.md", "\ufeffcafé")]
    assert "FileScan text" not in plain._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress("zwölf\n".encode()))
    (tmp_path / "d.txt").write_text("d")
    assert sorted(r.text for r in read_text(spark, str(tmp_path)).collect()) == ["d", "noël\r\n", "zwölf\n", "\ufeffcafé"]
    assert [tuple(r) for r in read_text(spark, str(tmp_path / "c.txt.gz")).collect()] == [("c.txt.gz", "zwölf\n")]


def test_a_listing_is_looked_through_by_few_tasks(spark, tmp_path):
    (tmp_path / "in" / "notes.txt").mkdir(parents=True)
    for i in range(32 * (LISTING_TASKS + 16)):
        (tmp_path / "in" / "notes.txt" / f"{i}").write_bytes(b"x")
    spark.sparkContext.setJobGroup("listing", "list_entries")
    try:
        entries = list_entries(spark, str(tmp_path / "in"))
        status = spark.sparkContext.statusTracker()
        stages = [s for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
        tasks = [status.getStageInfo(s).numTasks for s in stages if status.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(e.name, e.folder, e.nested) for e in entries] == [("notes.txt", True, False)] and 0 < max(tasks) <= LISTING_TASKS
