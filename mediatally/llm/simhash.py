"""Near-duplicates by SimHash fingerprints in BK-trees.

Each text becomes a 64-bit fingerprint of its word shingles. Equal fingerprints are grouped first, so what follows handles
each fingerprint once, however many texts share it. Fingerprints at most `radius` bits apart agree in at least one of
radius + 1 blocks of bits, so they are dealt to shards by block: one shard for each value of each block. A shard with more
than `shard_rows` fingerprints is dealt again by the blocks of its remaining bits, radius + 1 ways each time; after three
such steps with radius 2 at most 21 bits are free, so no shard tree can hold more than 2^21 fingerprints, whatever the data.
That bound is what lets a whole tree be handed to the task that searches it.

A shard is a BK-tree: a node's children are keyed by their Hamming distance to it. Each fingerprint is looked up in the
trees of its own shards, following only edges within the radius of its distance to the node. The trees of all shards a
task holds are built and searched together, level by level, as arrays. Handing every shard's tree to every fingerprint
would find nothing more and compare with all shards.

Of each shard only a spanning forest of its links leaves the task (less than one row per fingerprint). Components are the
usual alternation of large-star and small-star steps over tables in the shared folder, one written per round, so a lost
executor repeats a round at most.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; a text
with fewer words than a shingle is one shingle; equal rows share a component; a null doc_id is never a component's
smallest id while another is there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import small_batches, staged, table, texts, union_all, without

HASHES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 1 << 16
LEVELS = 3


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes."""
    found = text.lower().split()  # bytes: A-Z alone change case, and \x20 \x09-\x0D alone separate
    if not found:
        return 0
    shingles = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, shingles)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash and fingerprint (a signed long of the 64 bits) of each text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fingerprint"])

    small_batches(docs.sparkSession)
    return texts(docs, hashed=True).mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def block_masks(radius: int, levels: int = LEVELS) -> dict[str, int]:
    """Bits that a shard fixes, by its path of blocks: '0', '1', ... and '00', '01', ... below them."""

    def below(path: str, fixed: int, free: list[int], level: int) -> dict[str, int]:
        out = {}
        for k in range(radius + 1):
            block = free[k * len(free) // (radius + 1) : (k + 1) * len(free) // (radius + 1)]
            mask = fixed | sum(1 << b for b in block)
            out[path + str(k)] = mask
            if level < levels:
                out |= below(path + str(k), mask, [b for b in free if b not in block], level + 1)
        return out

    return below("", 0, list(range(64)), 1)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def dealt(fingers: DataFrame, paths: list[tuple[str, int]]) -> DataFrame:
    """Each fingerprint to one shard per path, with the number of fingerprints there; lone ones have no partner there."""
    keys: list[Column] = [
        F.struct(F.lit(p).alias("path"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("value")) for p, m in paths
    ]
    rows = fingers.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("fingerprint", "k.path", "k.value")
    sizes = rows.groupBy("path", "value").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, ["path", "value"])


def shards(fingers: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """path, value, fingerprint: every pair within the radius shares a shard; no shard holds more than it may."""
    masks = block_masks(radius)
    rows = staged(dealt(fingers, [(p, m) for p, m in masks.items() if len(p) == 1]), "simhash-shards")
    parts = []
    for level in range(1, LEVELS):
        parts.append(rows.where(F.col("n") <= shard_rows))
        large = rows.where(F.col("n") > shard_rows)
        found = large.select("path").distinct().collect()  # at most (radius + 1) ** level paths
        if not found:
            return union_all(parts)
        below = [
            staged(dealt(large.where(F.col("path") == r.path).select("fingerprint"),
                         [(p, m) for p, m in masks.items() if len(p) == level + 1 and p.startswith(r.path)]), "simhash-shards")
            for r in found
        ]
        rows = union_all(below)
    return union_all([*parts, rows])


class Forest:
    """The BK-trees of several shards, as arrays: `keys` holds parent * 65 + distance, sorted, `children` the nodes."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values
        _, first, inverse = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first[inverse]
        waiting = np.flatnonzero(self.root != np.arange(len(values)))
        at = self.root[waiting]
        keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(waiting):
            key = at * 65 + np.bitwise_count(values[waiting] ^ values[at])
            own, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            keys.append(own)
            children.append(waiting[first])
            at = waiting[first][inverse]
            rest = at != waiting
            waiting, at = waiting[rest], at[rest]
        order = np.argsort(key := np.concatenate(keys), kind="stable")
        self.keys, self.children = key[order], np.concatenate(children)[order]

    def within(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asked node, other node) at most `radius` apart, part by part."""
        stack = [(asked, self.root[asked])]
        while stack:
            query, node = stack.pop()
            if len(query) > PAIRS_AT_ONCE:
                half = len(query) // 2
                stack += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            apart = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            near = (apart <= radius) & (query != node)
            yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(apart + radius, 64), side="right")
            n = high - low
            if n.any():
                start = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                stack.append((np.repeat(query, n), self.children[start + np.arange(n.sum())]))


def joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of each pair; a label is the smallest index of its class."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def links(rows: DataFrame, radius: int) -> DataFrame:
    """A spanning forest of the links in each shard: fingerprints a, b."""

    def found(shard: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        forest = Forest(values.view(np.uint64), shard)
        label = np.arange(len(values))
        for at in range(0, len(values), 4096):
            for query, node in forest.within(np.arange(at, min(at + 4096, len(values))), radius):
                label = joined(label, query, node)
        linked = np.flatnonzero(label != np.arange(len(values)))
        return pa.RecordBatch.from_pydict({"a": pa.array(values[linked]), "b": pa.array(values[label[linked]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come one after the other; several are searched together, none is cut."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            path = batch.column(0).cast(pa.int64()).to_numpy()
            mine, values = np.stack([path, batch.column(1).to_numpy()]), batch.column(2).to_numpy()
            held.append((mine, values))
            if sum(len(v) for _, v in held) >= ROWS_AT_ONCE:
                keys, values = np.concatenate([k for k, _ in held], axis=1), np.concatenate([v for _, v in held])
                last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
                cut = last[-1] + 1 if len(last) else 0  # the last shard may go on in the next batch
                if cut:
                    yield found(numbered(keys[:, :cut]), values[:cut])
                held = [(keys[:, cut:], values[cut:])]
        if held:
            yield found(numbered(np.concatenate([k for k, _ in held], axis=1)), np.concatenate([v for _, v in held]))

    ordered = rows.select("path", "value", "fingerprint").repartition("path", "value").sortWithinPartitions("path", "value")
    return ordered.mapInArrow(run, "a long, b long")


def numbered(keys: np.ndarray) -> np.ndarray:
    """Consecutive numbers for runs of equal keys."""
    return np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for every node of an edge but the roots."""

    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = staged(df, "components")
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # A row (a, b) points from the larger to the smaller node.
    edges, seen = checked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges, now = checked(small.where("a <> b").distinct())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, shard_rows: int = 1 << 15) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (smallest doc_id reachable); text_hash and root (the
    component's smallest fingerprint) say the same for rows whose ids are null or repeat."""
    rows = staged(fingerprints(docs, words, seed), "simhash-rows")
    fingers = staged(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-fingers")
    roots = components(links(shards(fingers.select("fingerprint"), radius, shard_rows), radius))
    placed = fingers.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    placed = placed.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fingerprint", "component_id", "root")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id", "text_hash", "root")


def without_near_copies(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The documents, all their columns, one of each component: that with the smallest id."""
    found = staged(simhash_components(docs, words, radius), "simhash-components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    members = found.join(best, "root")  # a root with very many members is a skewed join, which is split
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    # Equal rows of the best count as one row that stays and others that go.
    rows = members.select("root", "doc_id", "text_hash", stays.alias("stays")).groupBy("root", "doc_id", "text_hash", "stays").agg(F.count("*").alias("n"))
    rows = rows.select("doc_id", "text_hash", "stays", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    return without(docs, rows.select("doc_id", "text_hash", (F.col("stays") & (F.col("nth") == 1)).alias("kept")))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
