import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mediatally.llm import prefixtrie as P

from .conftest import table_rows

SCHEMA = "conv_id long, turn long, role string, text string, a string, b string, depth string, part string, place string"


def digest(role, text):
    role, data = role.encode(), text.encode()
    found = hashlib.blake2b(len(role).to_bytes(8, "little") + role + data, digest_size=16).digest()
    return tuple(np.frombuffer(found, np.int64).tolist())


def simple(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    own_saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in nodes.items()}
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own_saved[p]
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **parameters):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in P.prefix_trie(df, **parameters).collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA).repartition(7)


def made_rows():
    """Shared beginnings, copies, null turns and texts, ties, repeated rows, negative and missing ids, one long conversation and its copy."""
    rng = random.Random(4)
    rows = []
    openings = [("system", "you are kind"), ("user", "hello there  you"), ("user", None), (None, "")]
    for c in [*range(-30, 90, 1), 10**12, 10**12 + 7]:
        if c in (20, 41):
            continue
        n = rng.choice([0, 1, 1, 2, 3, 4, 6])
        turns = [rng.choice(openings) if k < 3 else ("assistant", f"answer {rng.randrange(3)}") for k in range(n)]
        for k, (role, text) in enumerate(turns):
            rows.append((c, rng.choice([k, k, k, None, 1]), role, text))
    for c in (200, 203):
        rows += [(c, k, "user", f"turn {k % 5}") for k in range(300)]
    rows += [(None, 0, "user", "no conversation")] * 3 + rows[:9]
    return rows


def test_node_tables():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 1000, 50_000):
        a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        twice = np.concatenate([a, a]), np.concatenate([b, b])
        nodes = P.NodeTable(*twice)
        slots = nodes.slots(a, b)
        assert nodes.size == n and sorted(slots.tolist()) == list(range(n))  # minimal and perfect
        assert (nodes.slots(a + np.uint64(1), b) == -1).all()  # foreign digests are told apart


@pytest.mark.parametrize("chunk", [P.CHUNK, 1, 5])
def test_made_conversations(spark, chunk):
    rows = made_rows()
    assert found(made(spark, rows), chunk=chunk) == simple(rows)


def test_conversations_over_several_ranges(spark):
    """Small ranges and batches: paths are cut between ranges, chunks and batches."""
    rows = made_rows()
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("37", "false", "3")):
            spark.conf.set(k, v)
        assert found(made(spark, rows), chunk=4) == simple(rows)
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_tables(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table_rows(spark, "conversations", "sf0.01")]
    assert found(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")) == simple(rows)


def test_odd_rows(spark):
    assert found(made(spark, [])) == []
    nothing = [(3, None, None, None), (3, None, None, None), (4, 1, None, "x " * 100_000)]
    assert found(made(spark, nothing)) == simple(nothing)
    turnless = [(c, 0, "user", "one") for c in range(1, 20)]
    assert found(made(spark, turnless)) == simple(turnless)
