"""CSV headers as data, scans of a batch, one reader for batch and stream, layouts, certified medians, fill over ranges."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from mediatally.operators import quantile
from mediatally.operators.fill import fill_times
from mediatally.operators.parse import parse_time_columns
from mediatally.sources.files import column_names, read_csv, read_json
from mediatally.streaming.daily import append_rows, arriving_csv


def test_column_names():
    assert column_names(["", "spend", "Spend", "spend_1", " ", "spend"]) == ["unnamed_0", "spend", "Spend_1", "spend_1_1", "unnamed_4", "spend_2"]


@pytest.mark.parametrize("text, kinds, rows", [
    ("date,,spend\n2024-01-01,x,5\n2024-01-02,y,6.5\n", {"date": "date", "unnamed_1": "string", "spend": "double"}, 2),
    ("date,spend,spend\n2024-01-01,1,5\n", {"date": "date", "spend": "bigint", "spend_1": "bigint"}, 1),
    ("﻿a,b\n1,true\n", {"a": "bigint", "b": "boolean"}, 1),
    ('"a\nq",b\n1,3\n', {"a\nq": "bigint", "b": "bigint"}, 1),
    ("a,b\n1,2\na,b\n", {"a": "string", "b": "string"}, 2),  # a later line that reads like the header is data
    ("a,b,c,d\n99999999999999999999,12d,2024-13-45,1e5\n.5,3,2024-01-01,Infinity\n", {"a": "double", "b": "string", "c": "string", "d": "double"}, 2),
    ("a,b\n", {"a": "string", "b": "string"}, 0),
])
def test_headers_are_data(spark, tmp_path, text, kinds, rows):
    (tmp_path / "t.csv").write_text(text)
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == kinds and df.count() == rows


def test_an_index_column_changes_no_total(spark, tmp_path):
    lines = ["date,spend,clicks"] + [f"2024-01-{d:02d},{d / 4},{d}" for d in range(1, 29)]
    (tmp_path / "plain.csv").write_text("\n".join(lines))
    (tmp_path / "indexed.csv").write_text("\n".join(f"{'' if not i else i - 1},{line}" for i, line in enumerate(lines)))
    totals = [read_csv(spark, str(tmp_path / n)).agg(F.sum("spend"), F.sum("clicks"), F.max("date")).first() for n in ("plain.csv", "indexed.csv")]
    assert totals[0] == totals[1]


def test_a_latin_batch_is_scanned_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("name,n\nnoël,1\n".encode("latin-1"))
    (tmp_path / "in" / "b.csv").write_bytes("name,n\ncafé,2\n".encode())
    df = read_csv(spark, str(tmp_path / "in"))  # one scan for the facts, which stay in a stage table
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation" in line]
    assert len([s for s in scans if "csv" in s]) == 1 and not [s for s in scans if "text" in s]
    assert sorted(map(tuple, df.collect())) == [("café", 2), ("noël", 1)]


@pytest.mark.parametrize("multiline", [False, True])
def test_stream_reads_as_the_batch_reader(spark, tmp_path, multiline):
    (tmp_path / "in").mkdir()
    broken = ',"two\nlines"' if multiline else ","
    (tmp_path / "in" / "a.csv").write_bytes(f'region,note,spend\n"say ""hi"", now"{broken},5\nNordküste,NA,6\n'.encode("latin-1"))
    (tmp_path / "in" / "b.csv").write_bytes("region,note,spend\nNordküste,,x\n".encode())
    schema = "region string, note string, spend double"
    rows = arriving_csv(spark, str(tmp_path / "in"), schema, files_per_trigger=1, multiline=multiline)
    append_rows(rows, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("region", "note", "spend").collect()
    batch = read_csv(spark, str(tmp_path / "in"), schema, multiline=multiline).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, batch), key=repr)
    assert ('say "hi", now', "two\nlines" if multiline else None, 5.0) in [tuple(r) for r in found]


@pytest.mark.parametrize("written, want", [
    ("1/15/24", "2024-01-15 00:00:00"), ("12/31/99", "1999-12-31 00:00:00"), ("15-Jan-2024", "2024-01-15 00:00:00"), ("2024/01/15 10:30", "2024-01-15 10:30:00"),
    ("01/15/2024 10:30 PM", "2024-01-15 22:30:00"), ("1/2/2024 3:04pm", "2024-01-02 15:04:00"), ("15.01.2024", "2024-01-15 00:00:00"),
    ("January 2024", "2024-01-01 00:00:00"), ("5 March 2021", "2021-03-05 00:00:00"), ("2024-01-15T10:30:00+02:00", "2024-01-15 08:30:00"),
    ("2024-01-15 10:30:00Z", "2024-01-15 10:30:00"), ("31/31/2024", None), ("junk", None), (None, None),
])
def test_layouts(spark, written, want):
    df = spark.createDataFrame([(written,)], "at_time string")
    found = parse_time_columns(df, ["at_time"]).first().at_time
    assert (None if found is None else str(found)) == want


def test_order_of_days_and_months_is_that_of_the_column(spark):
    rows = [("13.1.24", "1.13.24", "02/01/24"), ("2.1.24", "1.2.24 1:05 pm", "14/01/2024")]
    df = parse_time_columns(spark.createDataFrame(rows, "a string, b string, c string"), ["a", "b", "c"])
    assert [[str(v)[:16] for v in r] for r in df.collect()] == [
        ["2024-01-13 00:00", "2024-01-13 00:00", "2024-01-02 00:00"], ["2024-01-02 00:00", "2024-01-02 13:05", "2024-01-14 00:00"],
    ]


@pytest.mark.parametrize("low, high", [(-5.0, -1.0), (2000.0, 3000.0), (10.0, 11.0), (499.0, 499.5), (0.0, 999.0)])
def test_medians_from_a_wrong_bracket(spark, monkeypatch, low, high):
    values = [float(i % 997) for i in range(1000)] + [998.5]
    df = spark.createDataFrame([(v, v if v < 500 else None) for v in values], "v double, w double")
    held = quantile._sketched
    monkeypatch.setattr(quantile, "_sketched", lambda t: [b._replace(low=low, high=high) for b in held(t)])
    found = {r.metric: r.median for r in quantile.medians(df, ["v", "w"]).collect()}
    assert found == {"v": statistics.median(values), "w": statistics.median(v for v in values if v < 500)}


def test_fill_evaluates_its_input_once_and_is_the_same_for_any_ranges(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(2000).mapInPandas(counted, "id bigint")
    at = F.when(F.col("id") % 7 == 3, F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz"))
    df = rows.select("id", (F.col("id") % 5).alias("k"), at.alias("at"))
    found = [sorted(map(tuple, fill_times(df, ["at"], ["k", "id"], n).collect())) for n in (1, 64, None)]
    assert found[0] == found[1] == found[2] and seen.value == 3 * 2000 and all(r[2] for r in found[0])


def _odd_json(rng):
    word = lambda: "".join(rng.choice('ab{}[]",:\\\né ') for _ in range(rng.randrange(12)))
    record = lambda i: {"id": i, "s": word(), "in": {"list": [{"t": word()} for _ in range(rng.randrange(3))], "e": {}, "n": [[], [1]]}}
    return [record(i) for i in range(rng.randrange(1, 60))]


def _plain(rows):
    return sorted((r.id, r.s, [x.t for x in r["in"].list]) for r in rows if r.id is not None)


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    """Arrays, pretty ones, nulls among records, objects one after the other: the same rows as json.loads, however ranges cut them."""
    rng = random.Random(8)
    shapes = [
        lambda rows: json.dumps(rows), lambda rows: json.dumps(rows, indent=2), lambda rows: "﻿ [null, " + json.dumps(rows, ensure_ascii=False)[1:-1] + ", null]\n",
        lambda rows: "\n".join(map(json.dumps, rows)), lambda rows: json.dumps(rows[0]),
    ]
    want, keys = [], ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    (tmp_path / "in").mkdir()
    for i in range(25):
        rows = [r | {"id": r["id"] + 1000 * i} for r in _odd_json(rng)]
        (tmp_path / "in" / f"{i}.json").write_text(shapes[i % 5](rows), encoding="utf-8")
        want += rows[:1] if i % 5 == 4 else rows
    want = sorted((r["id"], r["s"], [x["t"] for x in r["in"]["list"]]) for r in want)
    held = [spark.conf.get(k) for k in keys]
    try:
        for size in (97, 1000, 1 << 20):
            for k in keys:
                spark.conf.set(k, str(size))
            df = read_json(spark, str(tmp_path / "in"), split_above=0)
            assert _plain(df.collect()) == want, size
        spark.conf.set(keys[0], "1000")
        one = tmp_path / "one.json"
        one.write_text(json.dumps([{"id": i, "s": "}"} for i in range(1000)]))
        pieces = spark.read.option("lineSep", "}").text(str(one))
        assert pieces.rdd.getNumPartitions() > 10
        assert read_json(spark, str(one), split_above=0).agg(F.sum("id"), F.count("s")).first() == (499_500, 1000)
    finally:
        for k, v in zip(keys, held):
            spark.conf.set(k, v)


def test_cut_and_whole_reading_agree(spark, tmp_path):
    for name, text in {"a": '[{"a": 1, "b": "x}"}, {"a": null}]', "b": '{"data": [{"a": 1}, {"a": 2}]}', "c": '{"data": {"a": [1, 2], "b": [3, 4]}}', "d": "[]", "e": '{"a": {"b": []}}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
        found = []
        for above in (0, 1 << 20):
            try:
                found.append(sorted(map(str, read_json(spark, str(tmp_path / f"{name}.json"), split_above=above).collect())))
            except ValueError:
                found.append(None)
        assert found[0] == found[1], (name, found)
    for text in ('[{"a": 1}, {"a": 2}, {"a": 3', '[{"a": 1}, {"a": 2}', '﻿{"a": 1}\n{"a": 2}', '{"a": 1} {"a": 2}\n{"a": 3', '﻿[{"a": 1}, {"a": 2}, {"a": 3'):
        (tmp_path / "cut.json").write_text(text, encoding="utf-8")
        assert sorted(r.a for r in read_json(spark, str(tmp_path / "cut.json"), split_above=0).collect()) == [1, 2], text
