"""Removal of repeated substrings with suffix arrays built by induced sorting.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. To decide that
exactly without one array over the whole corpus, equal strings are brought together in shards:

1. Documents are packed into blocks of a few MB, equal texts once (the smallest id stands for them; the others lose all
   bytes if they are long enough). Blocks are a bucketed table, so later steps join to them without moving text.
2. A window is a string of `length` bytes. Its mark is the smallest hash of the `seed`-byte strings in it, so equal windows
   have equal marks, and windows next to each other mostly share theirs: a run. Blocks send each distinct mark with the
   number of its documents; marks of one document only are settled, because none of their windows can repeat.
3. Runs whose mark is left go, as strings, to the shard of their mark, equal strings of a block once. A mark with more than
   `hot` documents is split: its windows go one by one to the shards of their own hashes.
4. A shard's strings form one text. Its suffixes are classified, the leftmost-smaller (LMS) substrings sorted and named by
   induction, the string of names sorted recursively, and the suffix array induced from them, letter by letter, each in a few
   array operations. Permuted common prefixes are compared only where they are irreducible. Suffixes that share `length`
   bytes are neighbours, and the smallest id among them decides.
5. The answers, a bit per window, go back to the blocks, which cover the bytes and cut them out.

A task holds a block or a shard, whose sizes are parameters; the driver sees two numbers. The block table stays in the
session's catalog under a name of its own, as its files stay in the shared folder, because the result is read from it.

Defined results: a null text counts as empty; a text shorter than `length` keeps all bytes; rows with the same id are one
document, so none of them is smaller; a null id is larger than all others; of equal texts only the smallest id keeps bytes
that are nowhere else; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import small_batches, staged, table, texts
from mediatally.session import new_stage

LAST = (1 << 63) - 1  # stands for a null id
SEGMENT = 1 << 19  # windows handled as one array
MOST_BUCKETS = 20_000  # of the block table; a bucket holds several blocks beyond that
SEPARATOR = 0xFF  # no byte of UTF-8
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def string_hashes(letters: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on, by doubling."""
    size, found, whole, at = 1, BYTES[letters], None, 0
    while True:
        if k & size:
            part = found if not at else found[at:]
            if whole is None:
                whole = part
            else:
                n = min(len(whole), len(part))
                whole = whole[:n] * np.uint64(pow(BASE, size, 1 << 64)) + part[:n]
            at += size
        if 2 * size > k:
            return mixed(whole)
        found = found[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + found[size:]
        size *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


class Pieces(NamedTuple):
    """Uses of strings in a block (start, number of windows, id, string's number), and the distinct strings with their
    smallest ids and the shards they go to."""

    starts: np.ndarray
    windows: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    strings: list[bytes]
    least: np.ndarray
    deal: np.ndarray

    def by_deal(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with the numbers of its strings."""
        order = np.argsort(self.deal, kind="stable")
        cuts = np.flatnonzero(np.diff(self.deal[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            yield int(self.deal[own[0]]), own


class Block:
    """Texts of a block joined, and the runs of windows that share a mark: start, number of windows, mark, text."""

    def __init__(self, data: bytes, lengths: np.ndarray, length: int, seed: int):
        self.data, self.length = data, length
        self.letters = np.frombuffer(data, np.uint8)
        self.begins = np.cumsum(np.concatenate([[0], lengths]))[:-1].astype(np.int64)
        width = length - seed + 1
        steps = np.zeros(len(data) + 1, np.int8)
        long = lengths >= length
        np.add.at(steps, self.begins[long], 1)
        np.add.at(steps, self.begins[long] + lengths[long] - length + 1, -1)
        valid = np.cumsum(steps, dtype=np.int8)[:-1].astype(bool)
        starts, counts, marks = [], [], []
        for at in range(0, max(0, len(data) - length + 1), SEGMENT):
            part = self.letters[at : at + SEGMENT + length - 1]
            mark = sliding_least(string_hashes(part, seed), width)
            ok = valid[at : at + len(mark)]
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (mark[1:] != mark[:-1])
            first = np.flatnonzero(new)
            after = np.flatnonzero(ok & ~np.append(ok[1:] & ~new[1:], False)) + 1
            n = after - first
            pieces = -(-n // width)  # a long run of one mark, as in a repeated letter, is cut
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts.append(at + np.repeat(first, pieces) + k * width)
            counts.append(np.minimum(np.repeat(n, pieces) - k * width, width))
            marks.append(np.repeat(mark[first], pieces))
        self.starts = np.concatenate([*starts, np.empty(0, np.int64)]).astype(np.int64)
        self.counts = np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)
        self.marks = np.concatenate([*marks, np.empty(0, np.uint64)]).astype(np.uint64)
        self.text = np.searchsorted(self.begins, self.starts, side="right") - 1

    def seeds(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct marks by shard, the number of texts of each, and where each shard begins among them."""
        order = np.lexsort((self.text, self.marks, self.marks % np.uint64(shards)))
        mark, text = self.marks[order], self.text[order]
        once = np.ones(len(mark), bool)
        once[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
        mark = mark[once]
        first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else np.empty(0, np.int64)
        return mark[first], np.diff(np.append(first, len(mark))), np.searchsorted(mark[first] % np.uint64(shards), np.arange(shards + 1))

    def pieces(self, codes: np.ndarray, marks: np.ndarray, ids: np.ndarray, deals: int) -> Pieces:
        """The strings of the runs that are left (code 1), or of their single windows (code 2)."""
        order = np.argsort(marks)
        code = codes[order][np.searchsorted(marks[order], self.marks)] if len(marks) else np.empty(0, np.uint8)
        whole, split = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        n = self.counts[split]
        at = np.repeat(self.starts[split], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.concatenate([self.starts[whole], at])
        windows = np.concatenate([self.counts[whole], np.ones(len(at), np.int64)])
        owner = ids[np.concatenate([self.text[whole], np.repeat(self.text[split], n)])]
        numbers: dict[bytes, int] = {}
        number = [numbers.setdefault(self.data[a:b], len(numbers)) for a, b in zip(starts.tolist(), (starts + windows + self.length - 1).tolist())]
        number, strings = np.array(number, np.int64), list(numbers)
        least = np.full(len(strings), LAST)
        np.minimum.at(least, number, owner)
        first = np.empty(len(strings), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        keys = np.concatenate([self.marks[whole], np.fromiter((xxhash.xxh64_intdigest(strings[i]) for i in number[len(whole) :].tolist()), np.uint64, len(at))])
        deal = ((keys >> np.uint64(20)) % np.uint64(deals))[first].astype(np.int64) if len(first) else first
        return Pieces(starts, windows, owner, number, strings, least, deal)

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """The bytes that windows starting at these positions cover."""
        steps = np.zeros(len(self.data) + 1, np.int32)
        steps[windows] += 1
        np.subtract.at(steps, windows + self.length, 1)
        return np.cumsum(steps)[:-1] > 0


# Suffix arrays.

t_index = np.int32


def bytes_order(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, induced from the LMS suffixes in the given order. Each letter's bucket takes a few array operations."""
    letters = np.flatnonzero(np.bincount(t))
    small: list[list[np.ndarray]] = [[] for _ in range(int(t.max()) + 1)]
    seeds: list[list[np.ndarray]] = [[] for _ in small]

    def deal(lists: list[list[np.ndarray]], suffixes: np.ndarray, letter: np.ndarray) -> None:
        order = np.argsort(letter, kind="stable")
        suffixes, letter = suffixes[order], letter[order]
        cuts = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(letter)]):
            if b > a:
                lists[letter[a]].append(suffixes[a:b])

    none = np.empty(0, t_index)
    deal(seeds, lms, t[lms])
    larger: dict[int, np.ndarray] = {}
    for c in letters.tolist():  # L-type suffixes, from the smallest letter on
        wave = np.concatenate([none, *small[c]])
        done = []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            letter = t[before]
            deal(small, before[letter > c], letter[letter > c])
            wave = before[letter == c]
        larger[c] = np.concatenate([none, *done])
        before = np.concatenate([none, *seeds[c]]) - 1
        if len(before):
            deal(small, before, t[before])
    lists: list[list[np.ndarray]] = [[] for _ in small]
    out = []
    for c in letters[::-1].tolist():  # S-type suffixes, from the largest letter down, right to left
        wave = np.concatenate([none, *lists[c]])
        if c == 0:
            wave = np.array([len(t) - 1], t_index)  # the end of the text
        done = []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            letter = t[before]
            deal(lists, before[letter < c], letter[letter < c])
            wave = before[letter == c]
        before = larger[c][::-1]
        before = before[before > 0] - 1
        letter = t[before]
        deal(lists, before[letter < c], letter[letter < c])
        out += [np.concatenate([none, *done])[::-1], larger[c]]
    return np.concatenate(out[::-1])


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type)."""
    n = len(t)
    places = np.arange(n - 1, dtype=t_index)
    places[t[:-1] == t[1:]] = n - 2  # equal letters are as the next pair that differs; the last pair does
    nearest = np.minimum.accumulate(places[::-1])[::-1]
    out = np.empty(n, bool)
    out[:-1] = (t[:-1] < t[1:])[nearest]
    out[-1] = True
    return out


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of a text that ends in its only 0, right for the first `depth` letters at least."""
    if len(t) == 1:
        return np.zeros(1, t_index)
    smaller = smaller_types(t)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(t_index)
    order = bytes_order(t, lms)  # sorts the LMS substrings
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    number = np.zeros(len(t), t_index)
    number[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], len(t) - 1)  # an LMS substring reaches to the next LMS letter, included
    size = (ends - lms)[number[order]]
    same = np.zeros(len(order), bool)
    left, right = order[:-1], order[1:]
    alike = np.flatnonzero(size[1:] == size[:-1])
    for k in range(int(size.max()) + 1):
        over = k > size[1:][alike]
        same[1:][alike[over]] = True
        alike = alike[~over]
        if not len(alike):
            break
        alike = alike[t[left[alike] + k] == t[right[alike] + k]]
    else:
        same[1:][alike] = True
    same[order == len(t) - 1] = False
    names = np.empty(len(t), np.int64)
    names[order] = np.cumsum(~same) - 1
    reduced = names[lms]
    kinds = int(reduced.max()) + 1
    if kinds == len(reduced):
        ranked = np.argsort(reduced).astype(t_index)
    elif kinds <= 256:
        ranked = suffix_order(reduced, -(-depth // 2) + 1)
    else:  # many names: ranks of twice as many letters each round; an LMS substring has two letters of its own at least
        ranked = doubled(reduced, -(-depth // 2) + 1)
    return bytes_order(t, lms[ranked])


def doubled(t: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first `depth` letters at least. A round sorts those alone that are still tied."""
    n, size = len(t), 1
    order = np.argsort(t)
    ordered = t[order]
    rank = np.empty(n, np.int64)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    while True:
        # The rank of a tie is the place of its first member, so that ranks of later rounds fit in between.
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = head
        tied = np.flatnonzero(~first | ~np.append(first[1:], True))
        if size >= depth or not len(tied):
            return order.astype(t_index)
        suffix = order[tied]
        after = suffix + size
        key = head[tied] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key)
        order[tied], key = suffix[again], key[again]
        first[tied[1:]] |= key[1:] != key[:-1]
        size *= 2


def common_prefixes(raw: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """By position the length that its suffix shares with the one before it in the order, `most` at most being exact.

    Where the position before has the suffix just before this one's as its own neighbour, and both begin with the same
    letter, the value is one less than there; only the others, and the starts of strings, are compared, eight bytes at a time.
    """
    n = len(order)
    before = np.empty(n, order.dtype)
    before[order[1:]] = order[:-1]
    before[order[0]] = n - 1
    own = np.ones(n, bool)
    own[1:] = (before[1:] != before[:-1] + 1) | (raw[: n - 1] != raw[before[:-1]])
    own[starts] = True
    at = np.flatnonzero(own)
    other = before[at]
    padded = np.concatenate([raw, np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    found = np.zeros(len(at), np.int64)
    left = np.arange(len(at))
    for k in range(0, most + 8, 8):
        a = np.ascontiguousarray(words[at[left] + k]).view("<u8")[:, 0]
        b = np.ascontiguousarray(words[other[left] + k]).view("<u8")[:, 0]
        apart = a ^ b
        differs = apart != 0
        low = apart[differs]
        found[left[differs]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        left = left[~differs]
        if not len(left):
            break
    found[left] = most + 8
    steps = np.diff(at, append=n)
    return np.maximum(np.repeat(found + at, steps) - np.arange(n), 0)


def window_answers(strings: list[bytes], ids: np.ndarray, length: int) -> np.ndarray:
    """For each string the bits of its windows that also start in a string of a smaller id."""
    sizes = np.array([len(s) for s in strings], np.int64)
    raw = np.frombuffer(bytes([SEPARATOR]).join(strings) + bytes([SEPARATOR, 0]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    t = raw.astype(np.uint16) + 1
    t[-1] = 0
    order = suffix_order(t, length)
    shared = common_prefixes(raw, order, starts, int(sizes.max()) + 1)
    shared[order[:2]] = 0  # the end of the text is like no other suffix
    group = np.cumsum(shared[order] < length) - 1
    owner = np.repeat(np.arange(len(strings)), np.append(sizes[:-1] + 1, sizes[-1] + 2))
    id_ = ids[owner]
    sorted_ids = id_[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(sorted_ids, first)[group - group[0]]
    marked = np.sort(order[least < sorted_ids])
    at = marked - starts[owner[marked]]
    inside = at + length <= sizes[owner[marked]]
    bits = np.zeros(len(t), np.uint64)
    bits[marked[inside]] = np.uint64(1) << at[inside].astype(np.uint64)
    return np.bitwise_or.reduceat(bits, starts)


# The steps over tables.


def packed(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends.tolist()], ends.tolist())]


def packed_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The texts in blocks, one row each, as a table bucketed by block; and the number of bytes in all."""
    spark = docs.sparkSession
    source = texts(docs)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[int]] = {}
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(text, []).append(LAST if id_ is None else id_)
            at = [xxhash.xxh64_intdigest(t.encode()) % blocks for t in held]
            kinds = [pa.int32(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((at, list(held), list(held.values())), kinds)], ["block", "text", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one block after the other, as they come sorted by block; one block is held at a time."""
        now, held = None, {}
        for batch in batches:
            for at, text, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now and held:
                    yield packed_block(now, held)
                    held = {}
                now = at
                held.setdefault(text, []).extend(ids)
        if held:
            yield packed_block(now, held)

    def packed_block(at: int, own: dict[str, list[int]]) -> pa.RecordBatch:
        lists = [np.sort(np.array(ids, np.int64)) for ids in own.values()]
        data = [t.encode() for t in own]
        arrays = (np.array([len(d) for d in data], np.int64), np.array([len(i) for i in lists], np.int64), np.concatenate(lists))
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(*arrays, b"".join(data))], pa.binary())], ["block", "data"])

    small_batches(spark)
    buckets = min(blocks, MOST_BUCKETS)
    rows = source.mapInArrow(gathered, "block int, text string, ids array<long>").repartition(buckets, "block").sortWithinPartitions("block")
    name = f"blocks_{uuid.uuid4().hex}"
    rows = rows.mapInArrow(joined, "block int, data binary")
    rows.write.bucketBy(buckets, "block").option("path", new_stage(spark, "suffix-blocks")).saveAsTable(name)
    return spark.table(name), total


def opened(data: bytes, length: int, seed: int) -> tuple[Block, list[np.ndarray]]:
    """A block, and the sorted ids of each of its texts."""
    lengths, copies, ids, joined = unpacked(data)
    block = Block(joined, np.frombuffer(lengths, np.int64), length, seed)
    return block, np.split(np.frombuffer(ids, np.int64), np.cumsum(np.frombuffer(copies, np.int64))[:-1])


def mark_counts(blocks: DataFrame, shards: int, length: int, seed: int) -> DataFrame:
    """shard, block, data: the distinct marks of a block that belong to the shard, and how many texts hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block, _ = opened(data, length, seed)
                marks, counts, cuts = block.seeds(shards)
                counts = np.minimum(counts, 65535).astype(np.uint16)
                own = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
                parts = [packed((marks[cuts[s] : cuts[s + 1]] >> np.uint64(24)).astype(np.uint32), counts[cuts[s] : cuts[s + 1]]) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([at] * len(own), pa.int32()), pa.array(parts, pa.binary())], ["shard", "block", "data"])

    return blocks.select("block", "data").mapInArrow(run, "shard int, block int, data binary")


CODES = pa.schema([("block", pa.int32()), ("step", pa.int32()), ("shard", pa.int32()), ("data", pa.binary()), ("left", pa.int64())])


def repeated_marks(counts: DataFrame, hot: int) -> DataFrame:
    """For each part its marks' codes: 0 settled, 1 in two texts or more, 2 in more than `hot`."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [unpacked(d) for d in rows["data"].to_pylist()]
        marks, n = (np.concatenate([np.frombuffer(p[i], k) for p in parts]) for i, k in enumerate((np.uint32, np.uint16)))
        _, kind = np.unique(marks, return_inverse=True)
        total = np.bincount(kind, weights=n)[kind]
        codes = (total >= 2).astype(np.uint8) + (total > hot)
        each = np.split(codes, np.cumsum([len(p[0]) // 4 for p in parts])[:-1])
        return pa.table({
            "block": rows["block"], "step": pa.array([0] * len(parts), pa.int32()), "shard": rows["shard"],
            "data": pa.array([packed(c) for c in each], pa.binary()), "left": pa.array([int((c > 0).sum()) for c in each], pa.int64()),
        }, schema=CODES)

    return counts.groupBy("shard").applyInArrow(run, "block int, step int, shard int, data binary, left long")


def left_pieces(block: Block, ids: list[np.ndarray], answers: list[dict], shards: int, deals: int) -> Pieces:
    marks, _, cuts = block.seeds(shards)
    codes = np.zeros(len(marks), np.uint8)
    for row in answers:
        if row["step"] == 0:
            codes[cuts[row["shard"]] : cuts[row["shard"] + 1]] = np.frombuffer(unpacked(row["data"])[0], np.uint8)
    return block.pieces(codes, marks, np.array([i[0] for i in ids], np.int64), deals)


def dealt_strings(blocks: DataFrame, codes: DataFrame, shards: int, deals: int, length: int, seed: int) -> DataFrame:
    """deal, block, data: the distinct strings of a block that go to a shard, with their smallest ids."""

    def run(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        at, parts = [], []
        for data in own["data"].to_pylist():
            block, ids = opened(data, length, seed)
            left = left_pieces(block, ids, answers.to_pylist(), shards, deals)
            for deal, own_numbers in left.by_deal():
                strings = [left.strings[i] for i in own_numbers.tolist()]
                at.append(deal)
                parts.append(packed(np.fromiter(map(len, strings), np.int64, len(strings)), left.least[own_numbers], b"".join(strings)))
        kinds = {"deal": pa.array(at, pa.int32()), "block": pa.array([key[0].as_py()] * len(at), pa.int32()), "data": pa.array(parts, pa.binary())}
        return pa.table(kinds)

    return blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(run, "deal int, block int, data binary")


def shard_answers(dealt: DataFrame, length: int) -> DataFrame:
    """The answers of each shard's suffix array, for each part in the order of its strings."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}  # equal strings of several blocks once
        uses, owners = [], []
        for data in rows["data"].to_pylist():
            sizes, own, joined = unpacked(data)
            cuts = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
            use = [numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip([0, *cuts], cuts)]
            uses.append(np.array(use, np.int64))
            owners.append(np.frombuffer(own, np.int64))
        strings = list(numbers)
        least = np.full(len(strings), LAST)
        np.minimum.at(least, np.concatenate(uses), np.concatenate(owners))
        bits = window_answers(strings, least, length)
        windows = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
        every = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
        out = [packed(np.where(own > least[use], every[use], bits[use])) for use, own in zip(uses, owners)]
        return pa.table({
            "block": rows["block"], "step": pa.array([1] * len(out), pa.int32()), "shard": rows["deal"],
            "data": pa.array(out, pa.binary()), "left": pa.array([0] * len(out), pa.int64()),
        }, schema=CODES)

    return dealt.groupBy("deal").applyInArrow(run, "block int, step int, shard int, data binary, left long")


def cut_texts(blocks: DataFrame, answers: DataFrame, shards: int, deals: int, length: int, seed: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept."""

    def run(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        columns: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        rows = found.to_pylist()
        for data in own["data"].to_pylist():
            block, ids = opened(data, length, seed)
            left = left_pieces(block, ids, rows, shards, deals)
            answers_of = {r["shard"]: np.frombuffer(unpacked(r["data"])[0], np.uint64) for r in rows if r["step"] == 1}
            bits = np.zeros(len(left.strings), np.uint64)
            for deal, own_numbers in left.by_deal():
                bits[own_numbers] = answers_of[deal]
            marked = np.where(left.owner > left.least[left.number], ~np.uint64(0), bits[left.number])
            windows = [
                left.starts[(left.windows > i) & ((marked >> np.uint64(i)) & np.uint64(1)).astype(bool)] + i
                for i in range(int(left.windows.max(initial=0)))
            ]
            gone = block.covered(np.concatenate([np.empty(0, np.int64), *windows]))
            ends = [*block.begins[1:].tolist(), len(block.data)]
            for begin, end, own_ids in zip(block.begins.tolist(), ends, ids):
                cut = gone[begin:end]
                removed, spans = int(cut.sum()), int((cut[1:] & ~cut[:-1]).sum()) + bool(end > begin and cut[0])
                kept = block.letters[begin:end][~cut].tobytes()
                for id_ in own_ids.tolist():
                    whole = id_ > own_ids[0] and end - begin >= length
                    columns["doc_id"].append(None if id_ == LAST else id_)
                    columns["n_bytes"].append(end - begin)
                    columns["n_removed"].append(end - begin if whole else removed)
                    columns["n_spans"].append(1 if whole else spans)
                    columns["kept"].append(b"" if whole else kept)
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
        return pa.table({n: pa.array(columns[n], k) for n, k in kinds.items()})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_dedup(
    docs: DataFrame, length: int = 50, seed: int = 24, block_bytes: int = 1 << 22, shard_marks: int = 1 << 21,
    shard_bytes: int = 1 << 22, hot: int = 20_000,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each document."""
    if not 0 < length - seed + 1 <= 64:
        raise ValueError("a window's answers are held in 64 bits")
    if hot >= 65_535:
        raise ValueError("documents of a mark are counted up to 65,535 in a block")
    blocks, total = packed_blocks(docs, block_bytes)
    shards = max(1, total // (length - seed + 1) * 2 // shard_marks)
    codes = staged(repeated_marks(mark_counts(blocks, shards, length, seed), hot), "suffix-codes")
    left = codes.agg(F.sum("left")).first()[0] or 0
    deals = max(1, left * (length + 14) // shard_bytes)
    answers = staged(shard_answers(dealt_strings(blocks, codes, shards, deals, length, seed), length), "suffix-answers")
    return cut_texts(blocks, codes.unionByName(answers), shards, deals, length, seed)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
