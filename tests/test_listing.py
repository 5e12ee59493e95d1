"""Batches of many files: tasks list and read them, and the driver holds none."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mediatally.sources import listing
from mediatally.sources.batch import list_entries, read_batch
from mediatally.sources.files import literal_path, read_text
from workload import files

NOTES = 1500


@pytest.fixture()
def many(tmp_path):
    """A batch of two tables and a folder of many notes."""
    folder = tmp_path / "in"
    (folder / "notes.txt").mkdir(parents=True)
    (folder / "ads.csv").write_text("date,region,spend,clicks\n2024-01-01,West,1.5,2\n2024-01-02,East,2.5,3\n")
    (folder / "traffic.json").write_text(json.dumps([{"date": "2024-01-01", "region": "West", "visits": 5}]))
    for i in range(NOTES):
        (folder / "notes.txt" / f"part-{i:05d}.txt").write_text(f"Seen {i % 7} clicks.\n")
    return str(folder)


def _names_by_spark(spark, folder):
    found = spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("name"), "content").collect()
    return sorted((r.name, bytes(r.content).decode()) for r in found)


@pytest.mark.parametrize("store", ["", "file:", "file://"])
def test_files_are_listed_by_tasks(spark, many, store):
    texts = read_text(spark, f"{store}{many}/notes.txt")
    assert len(texts.inputFiles()) < 10 and texts.rdd.getNumPartitions() < NOTES / 32  # not one for every few files
    assert sorted(tuple(r) for r in texts.collect()) == [(f"part-{i:05d}.txt", f"Seen {i % 7} clicks.\n") for i in range(NOTES)]


def test_names_are_those_of_sparks_reader(spark, tmp_path):
    shown = ["a b.txt", "é%20.txt", "x#?[1]{y}*.txt", 'q"\\^`|<>.txt', "_k=1.txt", "n  .txt", "plus+,;=&@$!'()~.txt", "\U0001f600.txt"]
    for name in [*shown, "_hidden.txt", ".dot.txt", "x.txt._COPYING_"]:
        (tmp_path / name).write_text(f"in {name}")
    (tmp_path / "empty.txt").write_text("")
    os.symlink(tmp_path / "nothing", tmp_path / "lost.txt")
    found = sorted(tuple(r) for r in read_text(spark, str(tmp_path)).collect())
    assert found == _names_by_spark(spark, str(tmp_path)) and len(found) == len(shown)


def test_contents_come_in_chunks(spark, tmp_path):
    big = listing.CHUNK_BYTES // 2 + 1
    for i in range(5):
        (tmp_path / f"{i}.txt").write_bytes(bytes([65 + i]) * big)
    found = read_text(spark, str(tmp_path)).select("source_file", F.length("text").alias("n"), F.left("text", F.lit(1)).alias("first")).collect()
    assert sorted(tuple(r) for r in found) == [(f"{i}.txt", big, chr(65 + i)) for i in range(5)]


def test_tasks_are_bounded_by_files_and_bytes(spark, tmp_path):
    tasks = lambda found, size: listing.contents_on_disk(str(tmp_path), spark.createDataFrame([], "name string, label string"), found, size).rdd.getNumPartitions()
    assert tasks(0, 0) == 1 and tasks(1_600_000, 1) == 3200 and tasks(10, 100 * listing.BYTES_OF_A_TASK) == 100


def test_folders_within_are_left_to_spark(spark, tmp_path):
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "a.txt").write_text("a")
    assert [tuple(r) for r in read_text(spark, str(tmp_path)).collect()] == [("a.txt", "a")]
    for path in (f"{tmp_path}/none", f"file:{tmp_path}/none"):
        with pytest.raises(AnalysisException):
            read_text(spark, path)
    assert listing.folder_on_disk(spark, f"{tmp_path}/*") is None and listing.folder_on_disk(spark, f"viewfs:{tmp_path}") is None


@pytest.mark.parametrize("store", ["", "file:"])
def test_entries_are_those_of_a_listing(spark, tmp_path, monkeypatch, store):
    root = tmp_path / "in [1]"
    for name in (
        "b.csv/p.csv", "a.csv", "c.csv/k=1/p.csv", "d.csv/k/p.csv", "e.csv/_h/p.csv", "_f.csv/p.csv", "_g.csv", "h.csv/k=1/z/p.csv", "l.json", "m.txt/p.txt",
        "n.markdown", "o.md/.p.md", "é {x}*.csv/p.csv", "p.csv.bak", "q.CSV", ".csv", "other.bin", "u.csv/k=1/p.csv", "u.csv/y/_p.csv", "v.csv/y/z/p.csv",
    ):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    (root / "none.csv").mkdir()
    (root / "empty.csv").write_text("")
    (root / "y.csv" / "k").mkdir(parents=True)
    (root / "y.csv" / "k" / "p.csv").write_text("")
    os.symlink(root / "d.csv", root / "z.csv")
    os.symlink(root / "nothing", root / "lost.csv")
    found = list_entries(spark, f"{store}{root}")
    assert {e.name: (e.kind, e.folder, e.nested) for e in found} == {
        "a.csv": ("csv", False, False), "b.csv": ("csv", True, False), "c.csv": ("csv", True, False), "d.csv": ("csv", True, True),
        "h.csv": ("csv", True, False), "_f.csv": ("csv", True, False), "u.csv": ("csv", True, False), "v.csv": ("csv", True, True), "z.csv": ("csv", True, True),
        "é {x}*.csv": ("csv", True, False), "l.json": ("json", False, False), "m.txt": ("txt", True, False), "n.markdown": ("markdown", False, False),
    }
    assert [e.path for e in found if e.kind != "csv"] == [literal_path(f"{store}{root}/{n}") for n in ("l.json", "m.txt", "n.markdown")]
    monkeypatch.setattr("mediatally.sources.batch.folder_on_disk", lambda *a: None)  # as for a store that is not mounted
    assert found == list_entries(spark, f"{store}{root}")


def test_batch_scan_holds_no_file_in_the_driver(spark, many, monkeypatch):
    monkeypatch.setattr(files, "_batch_folder", lambda spark, sf: many)
    scan = files._s06(spark, "")
    assert len(scan.inputFiles()) < 10
    chars = sum(len(f"Seen {i % 7} clicks.\n") for i in range(NOTES))
    assert sorted((r.pos, r.filename, r.size) for r in scan.collect()) == [(1, "ads.csv", 2), (2, "traffic.json", 1), (3, "notes.txt", chars)]


def test_ingest_statistics_hold_no_file_in_the_driver(spark, many, monkeypatch):
    monkeypatch.setattr(files, "_batch_folder", lambda spark, sf: many)
    statistics = files._s09(spark, "")
    assert len(statistics.inputFiles()) < 10
    assert sorted((r.filename, r.rows, r.columns) for r in statistics.collect()) == [("ads.csv", 2, 4), ("notes.txt", NOTES, 20), ("traffic.json", 1, 3)]


def test_batch_table_holds_no_file_in_the_driver(spark, many, monkeypatch):
    monkeypatch.setattr(files, "_batch_folder", lambda spark, sf: many)
    table = files._s06_table(spark, "")
    assert len(table.inputFiles()) < 10
    assert {(r.region, r.data_source_type): r.n for r in table.collect()} == {
        ("West", "structured"): 1, ("East", "structured"): 1, (None, "unstructured"): NOTES,
    }
