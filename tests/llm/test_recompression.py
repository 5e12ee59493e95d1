import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatally.llm import recompression as R

from .conftest import odd_rows, table_rows


def simple(rows, width=13):
    first, split = {}, []
    for i, text in rows:
        words, key = re.findall(r"[^\x20\x09-\x0D]+", text or ""), R.LAST if i is None else i
        split.append((i, key, words))
        for p in range(len(words) - width + 1):
            w = tuple(words[p : p + width])
            first[w] = min(first.get(w, R.LAST), key)
    out = []
    for i, key, words in split:
        gone, end = bytearray(len(words)), 0
        for p in range(len(words) - width + 1):
            if first[tuple(words[p : p + width])] < key:
                for q in range(max(p, end), p + width):
                    gone[q] = 1
                end = p + width
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g).encode()))
    return sorted(out, key=repr)


def found(df, **parameters):
    rows = R.substring_dedup(df, **parameters).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in rows), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
def test_marks_of_equal_windows(rounds):
    """Whatever stands around a window, its mark is the same; few words make long runs and symmetric pairs."""
    rng = random.Random(rounds)
    for _ in range(300):
        words = rng.sample([b"a", b"b", b"c", b"dd", b"e"], rng.choice([1, 2, 3, 5]))
        window = [rng.choice(words) for _ in range(13)]
        texts = []
        for _ in range(12):
            around = [[rng.choice(words) for _ in range(rng.randrange(20))] for _ in range(2)]
            texts.append((len(around[0]), b" ".join([*around[0], *window, *around[1]])))
        parse = R.Parse([t for _, t in texts], 13)
        marks = parse.marks(rounds)
        own = {int(marks[(parse.windows == parse.cuts[k] + at)][0]) for k, (at, _) in enumerate(texts)}
        assert len(own) == 1


def test_marks_are_shared_by_neighbours():
    rng = np.random.default_rng(2)
    text = " ".join(f"w{n}" for n in rng.integers(0, 5000, 20_000)).encode()
    marks = R.Parse([text], 13).marks(1)
    assert 3 < len(marks) / (1 + (marks[1:] != marks[:-1]).sum())


@pytest.mark.parametrize("parameters", [{}, {"block_bytes": 400}, {"block_bytes": 3000, "rounds": 1}, {"width": 5, "rounds": 3, "block_bytes": 1000}])
def test_made_texts(docs_of, parameters):
    rng = random.Random(7)
    words = ["a", "bb", "ccc", "é", "\x00", "The", "the"]
    parts = [" ".join(rng.choice(words[: rng.choice([1, 2, 7])]) for _ in range(rng.randrange(5, 40))) for _ in range(12)]
    kinds = [None, "", " \n\t ", "x " * 12, "y " * 13, "z\x0b" * 60, "    " * 9]
    rows = [
        (rng.choice([None, *range(50)]), rng.choice([*kinds, " \r\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))), rng.choice(parts)]))
        for _ in range(220)
    ]
    assert found(docs_of(rows), **parameters) == simple(rows, parameters.get("width", 13))


def test_tables_in_several_blocks(spark):
    rows = [(r.doc_id, r.text) for r in table_rows(spark, "documents", "sf0.01")]
    want = simple(rows)
    assert found(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), block_bytes=1 << 17) == want
    assert sum(r[2] for r in want) > 1000


def test_documents_are_shuffled_once(spark):
    plan = R.substring_dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan.write.format("noop").mode("overwrite").save()
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReusedExchange") >= 2


def test_rows_of_a_block_in_any_order(docs_of):
    """A shuffle from several executors delivers a block's rows in another order each time it is read."""
    rng = random.Random(3)
    parts = [" ".join(f"w{rng.randrange(99)}" for _ in range(20)) for _ in range(6)]
    rows = [(i, f"u{i} " * rng.randrange(15) + " ".join(rng.sample(parts, 2))) for i in range(60)]

    def blocks(rows):
        return docs_of(rows).coalesce(1).selectExpr("0 as block", "doc_id", "cast(text as binary) as text")

    shared = R.block_marks(blocks(rows), 13, 1).select("block", "mark")
    windows = R.block_windows(blocks(rows), shared, 13, 1).withColumn("smaller", F.lit(False)).where("several").select("block", "at", "smaller")
    for order in (rows, rows[::-1], rng.sample(rows, len(rows))):
        cut = R.cut_texts(blocks(order), windows, 13, 1).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in cut), key=repr) == simple(rows)


def test_odd_rows(odd_docs, no_docs):
    assert found(odd_docs) == simple([r[:2] for r in odd_rows()])
    assert found(no_docs) == []
