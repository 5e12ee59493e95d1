"""Records of large JSON arrays, with ranges of a few pieces, and what one task sorts."""

import json

import pytest
from pyspark.sql import functions as F

from mediatally.sources import files


@pytest.mark.parametrize("pieces", [1, 2, 7, 1 << 17])
def test_records_whatever_the_ranges(spark, tmp_path, monkeypatch, pieces):
    monkeypatch.setattr(files, "RANGE_PIECES", pieces)
    rows = [{"id": i, "s": '}] "{' * (i % 4) + "\\" * (i % 3), "in": [{"t": "["}] * (i % 3)} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r | {"id": r["id"] + 1000}) for r in rows))
    got = sorted((json.loads(r.value) for r in files.json_records(spark, str(tmp_path)).collect()), key=lambda r: r["id"])
    assert got == [*rows, *(r | {"id": r["id"] + 1000} for r in rows)]


def test_places_are_dealt_by_the_bytes_of_the_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 1000)
    monkeypatch.setattr(files, "RANGE_PIECES", 4)
    made, held = {}, files.staged
    monkeypatch.setattr(files, "staged", lambda df, name: made.setdefault(name, held(df, name)))
    (tmp_path / "a.json").write_text(json.dumps([{"id": i} for i in range(3000)]))
    assert files.json_records(spark, str(tmp_path / "a.json")).agg(F.count_distinct("value")).first()[0] == 3000
    for name in ("json-depths", "json-ends"):  # about 35 kB of text: 36 tasks, none with more than a part of the places
        a_file = made[name].groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n")).agg(F.count("n"), F.max("n")).first()
        assert a_file[0] > 20 and a_file[1] < 600, name
