"""Prefix trie of conversations, in tables of nodes under minimal perfect hashes.

1. Turns become two 64-bit digests and a word count, are sorted by conversation and turn into ranges of even size, and
   numbered. A conversation can lie across ranges: each range tells how far its last conversation came, and the next one
   counts on from there. One row per range goes through the driver.
2. Conversations are rebuilt; only the first turns of donors, three at most, travel.
3. A prefix is the sum of its turns' digests mixed with their places, two lanes modulo 2^64, so prefix digests too go on
   from range to range. Equal prefixes have equal digests, wherever they are.
4. Of each chunk of rows a task enumerates the distinct digests, gives each a slot by a minimal perfect hash (a look-up
   compares the whole digest kept in the slot, so that a foreign one is seen), and scatters counts and smallest ids into
   flat arrays by slot. Spark adds up the nodes of all chunks, each of which has a node once, however many conversations pass it.
5. What a node adds to its ancestors (a leaf, saved tokens) is put into the path of its smallest member, which holds all
   of them. Chunks of whole paths, the deepest turns first, scatter it again and accumulate through the arrays of parent
   slots in order of depth; a path cut by a chunk's end hands on what it gathered. Spark adds up.

Defined results: a row without a conv_id belongs to no conversation; null turns come first; turns with the same number are
ordered by the digests of their role and text, repeated rows are turns of their own; null role or text counts as empty; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import or_empty, small_batches, staged, table

DONOR, KINDS = 20, 4  # a conversation may begin like the one whose id is the next lower multiple of DONOR, by fewer than KINDS turns
CHUNK = 1 << 17  # rows whose nodes make one table
PIECE = 1 << 16  # bytes of joined ids in one row
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
NOTHING = hashlib.sha256(b"").hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]


class NodeTable:
    """Distinct digests under a minimal perfect hash: each level settles the keys that are alone in their place."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        left_a, left_b = a[new], b[new]
        self.size = len(left_a)
        self.a, self.b = np.empty_like(left_a), np.empty_like(left_b)
        self.levels: list[np.ndarray] = []  # place -> slot, or -1
        done = 0
        while len(left_a):
            place = self.places(left_a, left_b, len(self.levels), 2 * len(left_a))
            alone = np.bincount(place, minlength=2 * len(left_a))[place] == 1
            level = np.full(2 * len(left_a), -1)
            level[place[alone]] = np.arange(done, done + alone.sum())
            self.a[done : done + alone.sum()], self.b[done : done + alone.sum()] = left_a[alone], left_b[alone]
            done += int(alone.sum())
            self.levels.append(level)
            left_a, left_b = left_a[~alone], left_b[~alone]

    @staticmethod
    def places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.array([level + 1], np.uint64) * GOLDEN
        return ((mixed(a + salt) ^ mixed(b ^ salt)) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not in the table."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for n, level in enumerate(self.levels):
            slot = level[self.places(a[left], b[left], n, len(level))]
            held = slot >= 0
            ours, slot = left[held], slot[held]
            same = (self.a[slot] == a[ours]) & (self.b[slot] == b[ours])
            out[ours[same]] = slot[same]
            left = left[~held]
        return out


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def running(keys: np.ndarray, values: np.ndarray, last_key: int | None, last_value: int) -> np.ndarray:
    """Sums from the first row of each key on, which goes on from the batch before."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.cumsum(values, dtype=values.dtype)
    before = np.concatenate([np.zeros(1, values.dtype), total])[first]
    if last_key is not None and last_key == keys[0]:
        before[0] -= np.array([last_value], np.uint64).astype(values.dtype)[0] if values.dtype == np.uint64 else last_value
    return total - np.repeat(before, np.diff(np.append(first, len(keys))))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, x, y, words of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                role, data = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                found.append(hashlib.blake2b(len(role).to_bytes(8, "little") + role + data, digest_size=16).digest())
                words.append(len(data.split()))
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "x", "y", "words"])

    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_empty("role").alias("role"), or_empty("text").alias("text"))
    return rows.where("conv_id is not null").mapInArrow(run, "conv_id long, turn long, x long, y long, words long")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, nth (from 0), x, y, words of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            nth = running(keys, np.ones(len(keys), np.int64), last, seen) - 1
            last, seen = int(keys[-1]), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(keys), part)), pa.array(nth), *batch.columns[2:]], ["conv_id", "part", "nth", "x", "y", "words"])

    by = ["conv_id", "turn", "x", "y"]
    ordered = turns.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = staged(ordered.mapInArrow(run, "conv_id long, part long, nth long, x long, y long, words long"), "trie-turns")
    far = rows.groupBy("part").agg(F.min("conv_id"), F.max("conv_id"), F.max_by(F.struct(F.col("nth") + 1), F.struct("conv_id", "nth")))
    return plus_carries(rows, carried(far.collect()), ["nth"]).drop("part")


def carried(ends: list) -> list[tuple]:
    """(part, conv_id, values) for each range that begins within a conversation. A row of `ends` has a range's number, its
    first and last conversation, and what the last one has reached there; there is one row per range."""
    out, last, values = [], None, ()
    for part, first, final, reached in sorted(ends, key=lambda r: r[0]):
        if last is not None and first == last:
            out.append((part, first, *values))
            reached = tuple(x + y for x, y in zip(reached, values)) if first == final else reached
        last, values = final, tuple(reached)
    return out


def plus_carries(rows: DataFrame, found: list[tuple], names: list[str]) -> DataFrame:
    """The rows with what was carried into their range added, for its first conversation; a row per range is broadcast."""
    if not found:
        return rows
    kinds = ", ".join(f"c_{n} long" for n in names)
    small = rows.sparkSession.createDataFrame(found, f"part long, conv_id long, {kinds}")
    joined = rows.join(F.broadcast(small), ["part", "conv_id"], "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(f"c_{n}", F.lit(0)) for n in names}).drop(*(f"c_{n}" for n in names))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (conv_id, place, x, y, words), and conv_id, n_turns of each, turnless ones too."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size"))
    firsts = turns.where((F.col("conv_id") % DONOR == 0) & (F.col("nth") < KINDS - 1))
    heads = firsts.groupBy(F.col("conv_id").alias("donor")).agg(F.sort_array(F.collect_list(F.struct("nth", "x", "y", "words"))).alias("head"))
    given = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % KINDS).cast("int")
    convs = sizes.withColumns({"given": given, "donor": F.col("conv_id") - F.col("conv_id") % DONOR}).join(heads, "donor", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("given"))))
    convs = convs.withColumn("own", F.coalesce(F.size("head"), F.lit(0)))
    n_turns = F.col("own") + F.greatest(F.col("size") - F.col("given"), F.lit(0))
    convs = staged(convs.select("conv_id", "given", "own", "head", n_turns.cast("long").alias("n_turns")), "trie-conversations")
    front = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.nth").alias("place"), "t.x", "t.y", "t.words")
    rest = turns.join(convs.select("conv_id", "given", "own"), "conv_id").where("nth >= given")
    rest = rest.select("conv_id", (F.col("nth") - F.col("given") + F.col("own")).alias("place"), "x", "y", "words")
    return front.unionByName(rest), convs.select("conv_id", "n_turns")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (digest of the prefix that ends here), pa, pb (that of its parent), words."""
    columns = ["conv_id", "part", "depth", "a", "b", "x", "y", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, [0, 0]
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, place = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64) + np.uint64(1)
            own = [mixed(x ^ mixed(place * GOLDEN + np.uint64(k))) for k, x in enumerate(lanes(batch, "x", "y"))]
            total = [running(keys, x, last, s) for x, s in zip(own, sums)]
            last, sums = int(keys[-1]), [int(t[-1]) for t in total]
            out = [keys, np.full(len(keys), part), place.view(np.int64), *(x.view(np.int64) for x in (*total, *own))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in out), batch.column(4)], columns)

    ordered = turns.repartitionByRange("conv_id", "place").sortWithinPartitions("conv_id", "place")
    rows = staged(ordered.mapInArrow(run, ", ".join(f"{c} long" for c in columns)), "trie-prefixes")
    far = rows.groupBy("part").agg(F.min("conv_id"), F.max("conv_id"), F.max_by(F.struct("a", "b"), F.struct("conv_id", "depth")))
    into = {part: (conv, a & M64, b & M64) for part, conv, a, b in carried(far.collect())}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, part = (batch.column(n).to_numpy() for n in ("conv_id", "part"))
            both, own = [x.copy() for x in lanes(batch, "a", "b")], lanes(batch, "x", "y")
            for p in set(np.unique(part).tolist()) & into.keys():
                conv, *more = into[p]
                at = (part == p) & (keys == conv)
                for lane, add in zip(both, more):
                    lane[at] += np.uint64(add)
            above = [x - y for x, y in zip(both, own)]
            out = [keys, batch.column("depth").to_numpy(), *(x.view(np.int64) for x in (*both, *above)), batch.column("words").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["conv_id", "depth", "a", "b", "pa", "pb", "words"])

    return staged(rows.mapInArrow(whole, "conv_id long, depth long, a long, b long, pa long, pb long, words long"), "trie-paths")


M64 = (1 << 64) - 1


def counted_nodes(paths: DataFrame) -> DataFrame:
    """a, b, pa, pb, depth, words, n_convs, conv_id (smallest member) of each node but the root."""
    names = ["a", "b", "pa", "pb", "depth", "words", "n_convs", "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, CHUNK):
            a, b = lanes(rows, "a", "b")
            nodes = NodeTable(a, b)
            slot = nodes.slots(a, b)
            out = {"n_convs": np.bincount(slot, minlength=nodes.size), "conv_id": np.full(nodes.size, np.iinfo(np.int64).max)}
            np.minimum.at(out["conv_id"], slot, rows.column("conv_id").to_numpy())
            for name in names[:6]:
                out[name] = np.empty(nodes.size, np.int64)
                out[name][slot] = rows.column(name).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names)

    found = paths.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    same = [F.any_value(n).alias(n) for n in ("pa", "pb", "depth", "words")]
    return found.groupBy("a", "b").agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


SUMS = ["a", "b", "n_leaves", "saved", "conv_id", "depth"]


def subtree_sums(paths: DataFrame, nodes: DataFrame, chunk: int) -> DataFrame:
    """a, b, n_leaves, saved: what the nodes of each subtree add up to, in rows still to be added up."""
    names = ["conv_id", "depth", "a", "b", "pa", "pb"]
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    none = F.lit(0).cast("long")
    both = paths.select(*names, none.alias("leaf"), none.alias("saved")).unionByName(nodes.select(*names, leaf.alias("leaf"), saved.alias("saved")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each chunk's nodes; where a range ends within a path a last row, with its conversation and depth."""
        handed, open_at = None, None  # parent digest and sums of a path that goes on; its conversation and depth
        for rows in chunks(batches, chunk):
            a, b, up, vp = lanes(rows, "a", "b", "pa", "pb")
            depth = rows.column("depth").to_numpy()
            nodes = NodeTable(a, b)
            slot = nodes.slots(a, b)
            parent, level = np.empty(nodes.size, np.int64), np.empty(nodes.size, np.int64)
            parent[slot], level[slot] = nodes.slots(up, vp), depth
            total = np.zeros((nodes.size, 2), np.int64)
            np.add.at(total, slot, np.stack([rows.column("leaf").to_numpy(), rows.column("saved").to_numpy()], 1))
            late = np.zeros(2, np.int64)
            if handed is not None:
                at = nodes.slots(*handed[:2])[0]
                if at >= 0:
                    total[at] += handed[2]
                else:  # this chunk is no more than the same node again
                    late = handed[2]
            order = np.argsort(-level, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
                group = group[parent[group] >= 0]
                np.add.at(total, parent[group], total[group])
            top, handed, open_at = slot[-1], None, None
            if level[top] > 1 and parent[top] < 0:
                handed, open_at = (up[-1:], vp[-1:], total[top] + late), (int(rows.column("conv_id")[-1].as_py()), int(level[top]))
            columns = [nodes.a.view(np.int64), nodes.b.view(np.int64), total[:, 0], total[:, 1]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *[pa.nulls(nodes.size, pa.int64())] * 2], SUMS)
        if handed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (0, 0, *handed[2].tolist(), *open_at)], SUMS)

    by = [F.col("conv_id"), F.col("depth").desc()]
    found = staged(both.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, ", ".join(f"{n} long" for n in SUMS)), "trie-sums")
    open_: dict[int, list] = {}  # at most one for each range
    for r in found.where("depth is not null").collect():
        open_.setdefault(r["conv_id"], []).append((r["depth"], r["n_leaves"], r["saved"]))
    sums = found.where("depth is null").select(*SUMS[:4])
    if not open_:
        return sums

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the cut paths hand on, for the nodes above the cuts."""
        for batch in batches:
            keys, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
            for conv in set(np.unique(keys).tolist()) & open_.keys():
                at = np.flatnonzero(keys == conv)
                cuts = np.array(sorted(open_[conv]))
                later = np.concatenate([np.cumsum(cuts[::-1, 1:], axis=0)[::-1], np.zeros((1, 2), np.int64)])
                more = later[np.searchsorted(cuts[:, 0], depth[at], side="right")]
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column("a"), own.column("b"), pa.array(more[:, 0].copy()), pa.array(more[:, 1].copy())], SUMS[:4])

    return sums.unionByName(paths.select("conv_id", "depth", "a", "b").mapInArrow(above, ", ".join(f"{n} long" for n in SUMS[:4])))


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of each node at which conversations end (a, b, conv_id). Ids are joined in pieces where the sorted
    ranges lie, and a node's pieces hashed one after the other; its sorted ids are never held together."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in ("a", "b", "conv_id", "ids")}
        for batch in batches:
            a, b, keys = (batch.column(n).to_numpy() for n in ("a", "b", "conv_id"))
            if not len(a):
                continue
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            for i, j in zip(new.tolist(), [*new[1:].tolist(), len(a)]):
                for k in range(i, j, PIECE // 16):
                    part = keys[k : min(j, k + PIECE // 16)].tolist()
                    for n, v in zip(held, (int(a[k]), int(b[k]), part[0], ",".join(map(str, part)))):
                        held[n].append(v)
            yield pa.RecordBatch.from_pydict(held, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.string())]))
            held = {n: [] for n in held}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids"))):
                if (a, b) == node:
                    state.update(f",{ids}".encode())
                    continue
                if node is not None:
                    out.append({"a": node[0], "b": node[1], "ends_sha256": state.hexdigest()})
                node, state = (a, b), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"a": node[0], "b": node[1], "ends_sha256": state.hexdigest()}], schema=schema)

    by = ["a", "b", "conv_id"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(joined, "a long, b long, conv_id long, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions(*by).mapInArrow(hashed, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node; the root too."""
    turns, convs = rebuilt(numbered(turn_digests(conversations)))
    paths = with_prefixes(turns)
    n_convs, root_id = convs.agg(F.count("*"), F.min("conv_id")).first()
    counted = staged(counted_nodes(paths), "trie-nodes")
    one = [F.lit(v).cast("long").alias(n) for n, v in (("a", 0), ("b", 0), ("pa", None), ("pb", None), ("depth", 0), ("words", 0), ("n_convs", n_convs), ("conv_id", root_id))]
    root = convs.limit(1).select(*one)
    children = counted.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = staged(counted.unionByName(root).join(children, ["a", "b"], "left").fillna({"n_children": 0}), "trie-shape")
    sums = subtree_sums(paths, nodes.where("depth > 0"), chunk)
    # The root has no rows in any path: it gets what the nodes below it have, and its own leaf if it is all there is.
    tops = nodes.where("depth = 1").select("a", "b")
    sums = sums.groupBy("a", "b").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    sums = staged(sums, "trie-totals")
    whole = sums.join(tops, ["a", "b"], "left_semi").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    whole = whole.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    deepest = paths.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("end")).select("end.*", "conv_id")
    zero = F.lit(0).cast("long")
    ends = end_digests(deepest.unionByName(convs.where("n_turns = 0").select(zero.alias("a"), zero.alias("b"), "conv_id")))
    parents = nodes.where("depth > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums.unionByName(whole), ["a", "b"]).join(ends, ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(root_id).cast("long")).otherwise(F.col("parent_conv_id"))
    return found.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
