"""Removal of repeated passages of words, found by recompression.

A word goes if a window of `width` words that covers it also starts in a document with a smaller id. A round of recompression
names runs of one symbol, then pairs of neighbours of which the first is of the left and the second of the right sort. Names
and sorts are hashes of what they stand for, so they are global: equal strings get equal symbols in every task, but for
the symbols at their edges, which what stands outside can change.

1. Of equal texts the one with the smallest id goes on; the others lose all words if they are long enough. Texts are compared
   by two hashes, 128 bits; only those whose hash is in a bitmap of the repeated ones, of fixed size, are moved for it.
2. Documents are dealt to blocks of a few MB by a hash. Each block is parsed for `rounds` rounds. From a window's words alone
   it follows which symbols are certain, whatever surrounds it: a round takes off the runs at both edges, whose length is open,
   and a symbol next to them that pairs with one. The window is filed under its mark: of the certain symbols of the highest
   round that has any, neighbours are named together in threes, and the smallest of these names is the mark (fewer than three
   symbols: all of them; none, as within a long run: the window itself).
3. Equal windows have equal marks, and windows next to each other mostly share theirs. Marks held by one document only are
   settled: none of their windows can repeat. Spark finds the others, from one row a block and mark.
4. Windows under marks that are shared are verified: of each window, named by the hash of all its words beside the mark, 96
   bits in all, Spark finds the smallest document, again from one row a block. More marks than repeats are shared (a phrase
   of a few words), so this decides alone; marks only spare the others.
5. Blocks take back the windows that start in a smaller document and cut the words that these cover. Windows are known by
   their place in the block, so steps 4 and 5 put its rows in the order of ids and texts, however the shuffle delivers them.

The three steps over blocks use one shuffle of the documents, which Spark reuses. A task holds one block; a passage in a third
of all documents is one row per block in steps 3 and 4, not one per document; the driver sees a number.

Defined results: a null text counts as empty; a text of fewer than `width` words keeps all; rows with the same id are one
document, so none of them is smaller; a null id is larger than all others; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediatally.llm.common import bitmap, staged, table, texts, with_hits

LAST = (1 << 63) - 1  # stands for a null id
BYTES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
PAIR, RUN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
WORD = "[^\\x20\\x09-\\x0D]+"
BITS = 1 << 24  # of the bitmap of repeated texts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Parse:
    """Words of some texts, and where the windows start: word hashes, and the first and last word of each text."""

    def __init__(self, held: list[bytes], width: int):
        data = b"\n".join([*held, b""])
        letters = np.frombuffer(data, np.uint8)
        dark = (letters != 32) & ((letters < 9) | (letters > 13))
        edges = np.flatnonzero(np.diff(dark, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(BYTES[letters] * powers(BASE, len(letters)), out=sums[1:])
        self.names = mixed((sums[ends] - sums[starts]) * powers(BACK, len(letters))[starts])
        begins = np.cumsum(np.array([0, *(len(t) + 1 for t in held)], np.int64))
        self.cuts = np.searchsorted(starts, begins)  # first word of each text, and the number of words
        self.sizes = np.diff(self.cuts)
        self.width = width
        free = np.maximum(self.sizes - width + 1, 0)
        self.text = np.repeat(np.arange(len(held)), free)
        self.windows = np.arange(len(self.text)) - np.repeat(np.cumsum(free) - free, free) + np.repeat(self.cuts[:-1], free)

    def window_names(self, windows: np.ndarray) -> np.ndarray:
        found = np.full(len(windows), self.width, np.uint64)
        for k in range(self.width):
            found = (found ^ self.names[windows + k]) * PAIR
            found ^= found >> np.uint64(31)
        return found

    def marks(self, rounds: int) -> np.ndarray:
        """The mark of each window."""
        names = self.names
        first = np.zeros(len(names), bool)
        first[self.cuts[:-1][self.sizes > 0]] = True
        out = np.zeros(len(self.windows), np.uint64)
        open_ = np.arange(len(self.windows))  # windows that still have certain symbols: i to j
        i, j = self.windows, self.windows + self.width
        for k in range(rounds):
            if not len(open_):
                break
            new = first.copy()
            new[1:] |= names[1:] != names[:-1]
            heads = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            size = np.diff(np.append(heads, len(names)))
            letter, begins = names[heads], first[heads]
            named = np.where(size == 1, letter, mixed(letter * RUN + size.astype(np.uint64)))
            right = (mixed(letter ^ np.uint64(BASE + k & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
            second = np.zeros(len(heads) + 1, bool)
            second[1:-1] = right[1:] & ~right[:-1] & ~begins[1:]
            symbol_of = np.cumsum(~second[:-1]) - 1
            # What is certain of the windows: without the runs at the edges, and without what pairs with them.
            a, b = run_of[i] + 1, run_of[j - 1]
            left = a < b
            a = a + second[np.minimum(a, len(heads))]
            b = b - second[b]
            left &= a < b
            a, b, open_ = a[left], b[left], open_[left]
            i, j = symbol_of[a], symbol_of[b - 1] + 1
            lead = np.flatnonzero(~second[:-1])
            paired = second[lead + 1]
            after = named[np.minimum(lead + 1, len(heads) - 1)]
            names = np.where(paired, mixed(named[lead] * PAIR + after), named[lead])
            first = begins[lead]
            out[open_] = smallest_group(names, i, j)
        bare = np.flatnonzero(out == 0)  # nothing is certain: the window itself
        out[bare] = self.window_names(self.windows[bare])
        return out


def smallest_group(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each range of symbols the smallest name of three neighbours in it, or of what there is. Never zero."""
    n = len(names)
    two = mixed(names * PAIR + names[np.minimum(np.arange(n) + 1, n - 1)])
    three = mixed(two * PAIR + names[np.minimum(np.arange(n) + 2, n - 1)])
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    a, size = i[new], (j - i)[new]
    found = np.where(size > 2, three[a], np.where(size > 1, two[a], names[a]))
    for k in range(1, int(size.max(initial=0)) - 2):
        inside = np.flatnonzero(size > k + 2)
        found[inside] = np.minimum(found[inside], three[a[inside] + k])
    return np.maximum(found, np.uint64(1))[np.cumsum(new) - 1]


def opened(rows: pa.Table, width: int) -> tuple[np.ndarray, list[bytes], Parse]:
    ids = rows["doc_id"].fill_null(LAST).to_numpy()
    held = rows["text"].to_pylist()
    return ids, held, Parse(held, width)


def in_order(rows: pa.Table) -> pa.Table:
    """A block's rows by id and text. A shuffle may deliver them in another order each time, and windows are known by place."""
    return rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def by_key(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, and where each distinct one begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    return order, np.flatnonzero(new)


def block_marks(blocks: DataFrame, width: int, rounds: int) -> DataFrame:
    """mark, block, several: the distinct marks of a block, and whether several of its documents hold them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, _, parse = opened(rows, width)
        marks = parse.marks(rounds)
        turn = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (parse.text[1:] != parse.text[:-1])])) if len(marks) else []
        marks, owner = marks[turn], ids[parse.text[turn]]
        order, first = by_key(marks)
        lo, hi = extremes(owner[order], first)
        at = pa.array(np.full(len(first), key[0].as_py()), pa.int32())
        return pa.table([pa.array(marks[order][first].view(np.int64)), at, pa.array(lo < hi)], ["mark", "block", "several"])

    return blocks.groupBy("block").applyInArrow(run, "mark long, block int, several boolean")


def extremes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(first):
        return values, values
    return np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)


def block_windows(blocks: DataFrame, shared: DataFrame, width: int, rounds: int) -> DataFrame:
    """name, mark, block, at, lo, several: the distinct windows of a block under shared marks, where they first start, their
    smallest document, and whether several of the block's documents hold them."""

    def run(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        ids, _, parse = opened(in_order(rows), width) if marks.num_rows else ([], [], None)
        left, names, mark, owner = (np.empty(0, k) for k in (np.int64, np.uint64, np.int32, np.int64))
        if parse:
            found, held = parse.marks(rounds), np.sort(marks["mark"].to_numpy().view(np.uint64))
            left = np.flatnonzero(held[np.minimum(np.searchsorted(held, found), len(held) - 1)] == found)
            names, mark, owner = parse.window_names(parse.windows[left]), short(found[left]), ids[parse.text[left]]
        order, first = by_key(names, mark)
        lo, hi = extremes(owner[order], first)
        head = order[first]
        columns = [pa.array(names[head].view(np.int64)), pa.array(mark[head]), pa.array(np.full(len(first), key[0].as_py()), pa.int32())]
        columns += [pa.array(left[head].astype(np.int32)), pa.array(lo, pa.int64()), pa.array(lo < hi)]
        return pa.table(columns, ["name", "mark", "block", "at", "lo", "several"])

    found = blocks.groupBy("block").cogroup(shared.groupBy("block"))
    return found.applyInArrow(run, "name long, mark int, block int, at int, lo long, several boolean")


def short(marks: np.ndarray) -> np.ndarray:
    return (marks & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def cut_texts(blocks: DataFrame, repeated: DataFrame, width: int, rounds: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept of each document. `repeated` has block, at, smaller: windows that start in a smaller
    document too, elsewhere (smaller) or in the block itself."""

    def run(key: tuple, rows: pa.Table, windows: pa.Table) -> pa.Table:
        rows = in_order(rows)
        ids, held, parse = opened(rows, width)
        gone = np.zeros(len(parse.names) + 1, np.int64)
        if windows.num_rows:
            names, marks = parse.window_names(parse.windows), short(parse.marks(rounds))
            at = windows["at"].to_numpy()
            at, smaller = at[order := np.lexsort((marks[at], names[at]))], windows["smaller"].to_numpy(zero_copy_only=False)[order]
            near = np.flatnonzero(names[at][np.minimum(np.searchsorted(names[at], names), len(at) - 1)] == names)
            found = np.full(len(near), -1)  # the window of the table that each is
            place, open_ = np.searchsorted(names[at], names[near]), np.arange(len(near))
            while len(open_):  # names of two strings may agree, then marks differ
                same = marks[at[place]] == marks[near[open_]]
                found[open_[same]] = place[same]
                open_, place = open_[~same], place[~same] + 1
                on = np.flatnonzero(place < len(at))
                on = on[names[at[place[on]]] == names[near[open_[on]]]]
                open_, place = open_[on], place[on]
            near, found = near[found >= 0], found[found >= 0]
            owner = ids[parse.text[near]]
            least = np.full(len(at), LAST)
            np.minimum.at(least, found, owner)
            starts = parse.windows[near[smaller[found] | (owner > least[found])]]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + width, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed[parse.cuts[1:]] - removed[parse.cuts[:-1]]
        kept = [
            b" ".join(compress(text.split(), (~gone[a:b]).tolist()) if n else text.split())
            for text, a, b, n in zip(held, parse.cuts[:-1].tolist(), parse.cuts[1:].tolist(), n_removed.tolist())
        ]
        columns = [rows["doc_id"], pa.array(parse.sizes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
        return pa.table(columns, ["doc_id", "n_words", "n_removed", "kept"])

    found = blocks.groupBy("block").cogroup(repeated.groupBy("block"))
    return found.applyInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def split_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text of the documents without copies; and the copies, whose text has a smaller id."""
    rows = texts(docs).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(13), "text")})
    id_ = F.coalesce("doc_id", F.lit(LAST))
    groups = rows.groupBy("h1", "h2").agg(F.min(id_).alias("first"), F.max(id_).alias("last")).where("first < last")
    groups = staged(groups.select("h1", "h2", "first"), "repeated-texts")
    slot = F.pmod(F.col("h1"), F.lit(BITS))
    seen = with_hits(rows.withColumn("slot", slot), bitmap(groups.select(slot.alias("slot")), BITS), "hit")
    joined = seen.where("hit").join(groups, ["h1", "h2"], "left")
    copy = F.coalesce(id_ > F.col("first"), F.lit(False))
    alone = seen.where("not hit").select("doc_id", "text").unionByName(joined.where(~copy).select("doc_id", "text"))
    return alone, joined.where(copy).select("doc_id", "text")


def substring_dedup(docs: DataFrame, width: int = 13, rounds: int = 1, block_bytes: int = 1 << 22) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, UTF-8, one blank between) of each document."""
    total = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    source, copies = split_copies(docs)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, total // block_bytes))).cast("int")
    blocks = source.select(block.alias("block"), "doc_id", F.col("text").cast("binary").alias("text"))
    mark, window = Window.partitionBy("mark"), Window.partitionBy("mark", "name")
    marks = block_marks(blocks, width, rounds).withColumn("blocks", F.count("*").over(mark))
    windows = block_windows(blocks, marks.where("blocks > 1 or several").select("block", "mark"), width, rounds)
    repeated = windows.withColumn("smaller", F.min("lo").over(window) < F.col("lo")).where("smaller or several")
    found = cut_texts(blocks, repeated.select("block", "at", "smaller"), width, rounds)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    answered = copies.select("doc_id", words.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), "words")
    long = F.col("n_words") >= width
    kept = F.when(long, F.lit("")).otherwise(F.array_join("words", " ")).cast("binary")
    return found.unionByName(answered.select("doc_id", "n_words", F.when(long, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"), kept.alias("kept")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
