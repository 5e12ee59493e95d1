import random

import numpy as np
import pytest

from mediatally.llm import suffixdedup as S

from .conftest import odd_rows, table_rows


def simple(rows, length=50):
    first = {}
    for i, text in rows:
        data, key = (text or "").encode(), S.LAST if i is None else i
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            first[w] = min(first.get(w, S.LAST), key)
    out = []
    for i, text in rows:
        data, key = (text or "").encode(), S.LAST if i is None else i
        gone, end = bytearray(len(data)), 0
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < key:
                for q in range(max(p, end), p + length):
                    gone[q] = 1
                end = p + length
        spans = sum(bool(gone[q] and not (q and gone[q - 1])) for q in range(len(data)))
        out.append((i, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def found(df, **parameters):
    rows = S.suffix_dedup(df, **parameters).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=repr)


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        letters = [rng.randrange(rng.choice([1, 2, 3, 20, 250])) + 1 for _ in range(rng.randrange(1, 200))] * rng.choice([1, 1, 3])
        t = np.array([*letters, 0], np.uint16)
        assert S.suffix_order(t, 10**6).tolist() == sorted(range(len(t)), key=lambda i: list(t[i:]))


def test_window_answers():
    rng = random.Random(2)
    for _ in range(150):
        base = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(10, 60))) for _ in range(4)]
        strings = list({b"".join(rng.choice(base) for _ in range(3))[: rng.randrange(8, 40)] for _ in range(rng.randrange(1, 30))})
        ids = np.array([rng.randrange(5) for _ in strings], np.int64)
        answers = S.window_answers(strings, ids, 8)
        for j, s in enumerate(strings):
            for i in range(len(s) - 7):
                want = any(ids[k] < ids[j] and s[i : i + 8] in other for k, other in enumerate(strings))
                assert bool(int(answers[j]) >> i & 1) == want


@pytest.mark.parametrize("parameters", [{}, {"block_bytes": 2000, "shard_marks": 500, "shard_bytes": 1500}, {"block_bytes": 3000, "hot": 3, "shard_bytes": 3000}])
def test_made_texts(docs_of, parameters):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abc d\n\x00é") for _ in range(rng.randrange(20, 150))) for _ in range(12)]
    kinds = [None, "", "x" * 49, "y" * 50, "z" * 500, "ab" * 200]
    rows = [
        (rng.choice([None, *range(60)]), rng.choice([*kinds, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))), rng.choice(parts)]))
        for _ in range(250)
    ]
    assert found(docs_of(rows), **parameters) == simple(rows)


def test_tables_in_several_blocks(spark):
    rows = [(r.doc_id, r.text) for r in table_rows(spark, "documents")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs, block_bytes=1 << 17, shard_bytes=1 << 17) == simple(rows)


def test_more_blocks_than_buckets(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "MOST_BUCKETS", 3)
    rows = [(r.doc_id, r.text) for r in table_rows(spark, "documents")][:60]
    assert found(docs_of(rows), block_bytes=1 << 11, shard_bytes=1 << 15) == simple(rows)
    with pytest.raises(ValueError):
        S.suffix_dedup(docs_of(rows), hot=70_000)


def test_odd_rows(odd_docs, no_docs):
    assert found(odd_docs) == simple([r[:2] for r in odd_rows()])
    assert found(no_docs) == []
