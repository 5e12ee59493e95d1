import random
import re

import numpy as np
import pytest
import xxhash

from mediatally.llm import simhash as S

from .conftest import odd_rows, table_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius=2):
    """Smallest index reachable from each value, by comparing all pairs."""
    values = np.array(values, np.uint64)
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            a, b = root(i), root(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def near_values(seed, n):
    """Families of fingerprints a few bits apart, chained, many sharing most bits."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        value = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):
            out.add(value)
            for _ in range(rng.randrange(1, 5)):
                value ^= 1 << rng.randrange(64)
    return sorted(out)


def test_tables_against_all_pairs(spark):
    rows = table_rows(spark, "documents")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op4_simhash_bktree(spark, "/root/testdata/sf0.001").collect()}
    rows.sort(key=lambda r: r.doc_id)
    values = [simple_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{v:016x}", rows[k].doc_id) for r, v, k in zip(rows, values, classes(values))}
    assert found == want


@pytest.mark.parametrize("shard_rows", [1 << 15, 3])
def test_links_lose_no_pair(spark, shard_rows):
    values = near_values(shard_rows, 1500)
    df = spark.createDataFrame([(S.signed(v),) for v in values], "fingerprint long").repartition(5)
    roots = {r.node: r.root for r in S.components(S.links(S.shards(df, 2, shard_rows), 2)).collect()}
    label = classes(values)
    mine: dict = {}
    for i, v in enumerate(values):
        mine.setdefault(roots.get(S.signed(v), S.signed(v)), set()).add(i)
    want: dict = {}
    for i, k in enumerate(label):
        want.setdefault(k, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_forest_finds_what_comparing_finds():
    values = np.array(near_values(1, 800), np.uint64)
    shard = np.sort(np.random.default_rng(2).integers(0, 4, len(values)))
    forest = S.Forest(values, shard)
    found = {(int(a), int(b)) for q, n in forest.within(np.arange(len(values)), 3) for a, b in zip(q, n)}
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    want = (apart <= 3) & (shard[:, None] == shard[None, :]) & ~np.eye(len(values), dtype=bool)
    assert found == {tuple(map(int, p)) for p in np.argwhere(want)}


def test_every_shard_is_bounded():
    masks = S.block_masks(2)
    assert len(masks) == 3 + 9 + 27
    assert max(64 - bin(m).count("1") for p, m in masks.items() if len(p) == S.LEVELS) <= 21


def test_long_chain_of_links(spark):
    value, values = 0, []
    for b in range(60):
        value |= 1 << b
        values.append(value)
    rows = spark.createDataFrame([(a, b) for a, b in zip(values, values[1:])], "a long, b long")
    assert {r.root for r in S.components(rows).collect()} == {1}


def test_odd_rows(spark, odd_docs, no_docs):
    found = S.simhash_components(odd_docs).collect()
    assert sorted(r.fingerprint for r in found) == sorted(S.signed(simple_fingerprint(r[1])) for r in odd_rows())
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[9].component_id == 1 and by_id[6].component_id == 5 and by_id[4].component_id == 2
    assert S.simhash_components(no_docs).count() == 0
    left = S.without_near_copies(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == len({r.root for r in found})
    assert S.without_near_copies(no_docs).count() == 0


def test_hot_fingerprint(spark, docs_of):
    docs = docs_of([(i, "the same few words" if i % 3 else f"text number {i} is its own") for i in range(300)])
    assert S.without_near_copies(docs).where("text = 'the same few words'").collect()[0].doc_id == 1
