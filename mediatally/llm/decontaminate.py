"""Benchmark decontamination: pairs of words join texts to test items, Smith-Waterman scores them.

1. An alignment with m matches and e mismatches or gaps has at most e + 1 runs of matches, so at least m - e - 1 of the
   item's pairs of neighbouring words stand in the passage. What counts is a score of `least` of an item's L words, but no
   single word of several (`floor`): of its L - 1 pairs these are T = max(ceil(least L), min(floor, L)) - 1, within
   (2 - least) L words (each word put in costs 1).
2. So of any L - 1 - T + k pairs of an item k stand there, whichever are chosen: nothing that scores enough is lost. The
   choice is for speed alone: the pairs that are in the fewest documents, all of which are counted, are the item's seeds,
   common phrases are left out first. That holds for items of any length; a single word is its own seed. Copies of an item in the corpus make its pairs common, which changes the choice but no result.
3. A scan of the corpus looks the seeds up, in passes of at most `at_once` seeds, and cuts out the passages with k seeds of
   an item near each other: the words that an alignment through them can reach.
4. Smith-Waterman alignment of words (match 1, mismatch and gap -1) gives the score, as a share of the item's words. It
   sees edits, and copies with words put in or left out, where no long n-gram is left.

What a pass sends is bounded by `at_once`; a bitmap of fixed size spares most look-ups, and a false hit there costs time.

Defined results: a null text counts as empty; an item without words is found nowhere; the rule on
scores is the same for items of every length, so half of a short item counts too; of items with the same id the best
score counts; rows that repeat give one row; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import PIECE, bitmap, kept_in_worker, small_batches, staged, table, texts, union_all, without

FOREIGN = re.compile(r"[^\w\x00-\x7f]+")  # beyond ASCII whatever is no letter or digit separates words
IS_WORD = np.array([c >= 0x80 or chr(c).isalnum() or c == 0x5F for c in range(256)])
AT_ONCE = 1 << 20  # bytes of text handled as one array; a longer text is one by itself

# Factors of the polynomial hash of a word's bytes, and its mixing.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


class Words:
    """The words of several texts as arrays: where they stand in the joined bytes, their text's number, their hashes."""

    def __init__(self, held: list[str]):
        low = (t.lower() for t in held)
        parts = [(t if t.isascii() else FOREIGN.sub(" ", t)).encode("utf-8", "surrogatepass") for t in low]
        self.data = b"\n".join([*parts, b""])
        letters = np.frombuffer(self.data, np.uint8)
        edges = np.flatnonzero(np.diff(IS_WORD[letters], prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        self.text = np.searchsorted(begins, self.starts, side="right") - 1
        self.hashes = self._hashes(letters)

    def _hashes(self, letters: np.ndarray) -> np.ndarray:
        """A word's polynomial is a difference of two sums over all bytes before, brought to the word's start."""
        n = len(letters)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[letters] * powers(BASE, n), out=sums[1:])
        found = (sums[self.ends] - sums[self.starts]) * powers(BACK, n)[self.starts]
        found = (found ^ (found >> np.uint64(32))) * MIX
        return found ^ (found >> np.uint64(29))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, as signed longs, and whether they are all of one text."""
        size = len(self.hashes) - n + 1
        if size <= 0:
            return np.empty(0, np.int64), np.empty(0, bool)
        found = np.full(size, n, np.uint64)
        for i in range(n):
            found = (found ^ self.hashes[i : size + i]) * MIX
            found ^= found >> np.uint64(29)
        return found.view(np.int64), self.text[:size] == self.text[n - 1 :]

    def hits(self, held: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Word and gram for each gram of these sizes that is in the bitmap."""
        words, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in sizes:
            grams, one = self.grams(n)
            slot = grams & (len(held) * 8 - 1)
            at = np.flatnonzero((held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool) & one)
            words.append(at)
            found.append(grams[at])
        return np.concatenate(words), np.concatenate(found)

    def between(self, start: int, end: int) -> list[str]:
        return [self.data[a:b].decode("utf-8", "replace") for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist())]


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 and so on, modulo 2 ** 64; kept for the next call."""
    held = kept_in_worker(("powers",), dict)
    if len(held.get(base, ())) < n:
        factors = np.full(max(n, AT_ONCE + 1), base, np.uint64)
        factors[0] = 1
        held[base] = np.cumprod(factors, dtype=np.uint64)
    return held[base][:n]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Words]]:
    """Keys (id, hash) and words of the rows (id, text, hash), some at a time."""
    for batch in batches:
        keys, held, size = [], [], 0
        for id_, text, text_hash in zip(*(c.to_pylist() for c in batch.columns)):
            if held and size + len(text) > AT_ONCE // 2:
                yield keys, Words(held)
                keys, held, size = [], [], 0
            keys.append((id_, text_hash))
            held.append(text)
            size += len(text)
        if held:
            yield keys, Words(held)


def item_grams(items: DataFrame) -> DataFrame:
    """item, words, and the pairs of neighbouring words of each test item; a single word is a gram by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Words([text])
                size = min(len(words.hashes), 2)
                grams = words.grams(size)[0].tolist() if size else []
                rows.append({"item_id": item, "words": words.between(0, len(words.hashes)), "size": size, "grams": grams})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("item_id", pa.int64()), ("words", pa.list_(pa.string())), ("size", pa.int32()), ("grams", pa.list_(pa.int64())),
            ]))

    return texts(items, key="item_id").mapInArrow(run, "item_id long, words array<string>, size int, grams array<long>")


def fetched(grams: DataFrame, bits: int) -> np.ndarray:
    """The grams as a bitmap of `bits` bits; what reaches the driver is bits / 8 bytes at most."""
    out = np.zeros(bits // 8, np.uint8)
    for row in bitmap(grams.select(F.pmod(F.col("gram"), F.lit(bits)).alias("slot")), bits).collect():
        out[row.piece * PIECE // 8 :][: PIECE // 8] = np.frombuffer(row.held, np.uint8)
    return out


def document_counts(docs: DataFrame, held, sizes: list[int]) -> DataFrame:
    """In how many documents each gram of the bitmap stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for _, words in chunks(batches):
            at, grams = words.hits(held.value, sizes)
            text = words.text[at]
            order = np.lexsort((grams, text))
            text, grams = text[order], grams[order]
            new = np.ones(len(order), bool)
            new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
            counts.update(grams[new].tolist())
            if len(counts) > 300_000:
                yield pa.RecordBatch.from_pydict({"gram": list(counts), "n": list(counts.values())})
                counts = Counter()
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    return texts(docs, hashed=True).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def seeds_of(items: DataFrame, counts: DataFrame, least: float, floor: int) -> DataFrame:
    """gram, item, near, span, size: any passage that scores enough has `near` of the item's seeds within `span` words."""
    length = F.size("words")
    # T of step 1; one word is its own seed.
    shared = F.greatest(F.ceil(F.lit(least) * length - 1e-9), F.least(F.lit(floor), length)) - 1
    shared = F.when(length == 1, 1).otherwise(shared)
    items = items.withColumn("shared", shared.cast("int"))
    near = F.least("shared", F.greatest(F.lit(2), F.expr("1 + shared div 3")))
    rows = items.select(
        "item", "size", "shared", near.cast("int").alias("near"), F.ceil(length * (2 - least)).cast("int").alias("span"),
        F.size("grams").alias("n_grams"), F.posexplode("grams").alias("at", "gram"),
    ).join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Equal grams of an item stand together, and the last place taken may be any of them.
    rows = rows.withColumn("place", F.expr("row_number() over (partition by item order by n, gram, at)"))
    return rows.where("place <= n_grams - shared + near").select("gram", "item", "near", "span", "size").distinct()


class Seeds:
    """Seeds by gram: those of grams[i] are rows first[i] to first[i + 1] of item, near and span."""

    def __init__(self, rows: list, bits: int):
        rows = sorted(rows, key=lambda r: (r.gram, r.item))
        grams = np.array([r.gram for r in rows], np.int64)
        self.grams, begins = np.unique(grams, return_index=True)
        self.first = np.append(begins, len(rows))
        self.item, self.near, self.span = (np.array([r[k] for r in rows], np.int64) for k in ("item", "near", "span"))
        self.sizes = sorted({r.size for r in rows})
        self.held = np.zeros(bits // 8, np.uint8)
        slot = self.grams & (bits - 1)
        np.bitwise_or.at(self.held, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))

    def stretches(self, words: Words) -> list[list[int]]:
        """text, item, start, end for each stretch with enough seeds of an item; those that overlap are one."""
        at, grams = words.hits(self.held, self.sizes)
        if not len(at):
            return []
        known = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        real = self.grams[known] == grams
        at, known = at[real], known[real]
        many = self.first[known + 1] - self.first[known]
        seed = np.arange(many.sum()) + np.repeat(self.first[known] - np.cumsum(many) + many, many)
        at = np.repeat(at, many)
        text, item = words.text[at], self.item[seed]
        order = np.lexsort((at, item, text))
        at, text, item, near, span = at[order], text[order], item[order], self.near[seed][order], self.span[seed][order]
        last = np.minimum(np.arange(len(at)) + near - 1, len(at) - 1)
        enough = (np.arange(len(at)) + near <= len(at)) & (text[last] == text) & (item[last] == item) & (at[last] - at < span)
        out: list[list[int]] = []
        for t, i, a, b, reach in zip(*(c.tolist() for c in (text[enough], item[enough], at[enough], at[last[enough]], span[enough]))):
            if out and out[-1][:2] == [t, i] and b - reach <= out[-1][3]:
                out[-1][3] = a + reach + 1
            else:
                out.append([t, i, b - reach, a + reach + 1])
        return out


def passages(docs: DataFrame, held) -> DataFrame:
    """doc_id, text_hash, item, start and words of the stretches of text that an alignment with the item can reach."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, words in chunks(batches):
            rows = []
            for text, item, start, end in held.value.stretches(words):
                first, last = np.searchsorted(words.text, [text, text + 1]).tolist()
                start = max(start, first)
                rows.append({"doc_id": keys[text][0], "text_hash": keys[text][1], "item": item, "start": start - first, "words": words.between(start, min(end, last))})
                if len(rows) > 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts(docs, hashed=True).mapInArrow(run, "doc_id long, text_hash long, item long, start long, words array<string>")


def best_row(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score (match 1, mismatch -1, gap -1) and where its alignment ends in the passage."""
    steps = np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above - 1, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, 1, -1))
        above = np.maximum.accumulate(row + steps) - steps  # a gap costs 1 a word
        at = int(above.argmax())
        if above[at] > best:
            best, end = int(above[at]), at
    return best, end


def align(item: list[str], passage: list[str]) -> tuple[int, int, int]:
    """Score, and the first and last (exclusive) word of the passage in the best alignment."""
    numbers: dict[str, int] = {}
    a, b = (np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in (item, passage))
    score, end = best_row(a, b)
    back = best_row(a[::-1], b[:end][::-1])[1]
    return score, end - back, end


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.5, floor: int = 2, bits: int = 1 << 24, at_once: int = 200_000) -> DataFrame:
    """doc_id, item_id, score (share of the item's words), start and end (words) of each leaked item, and text_hash.

    An item is leaked where its alignment scores `least` of its words and `floor` words (all of them where it has fewer).
    """
    if not 0 < least <= 1 or floor < 2:
        raise ValueError("least must be in (0, 1], floor 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    test = staged(item_grams(items).where("size > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    sizes = sorted(test.agg(F.collect_set("size").alias("sizes")).first().sizes)
    every = spark.sparkContext.broadcast(fetched(test.select(F.explode("grams").alias("gram")), bits))
    counts = document_counts(docs, every, sizes)
    seeds = seeds_of(test, counts, least, floor)
    n_passes = max(1, -(-(test.agg(F.sum(F.size("grams"))).first()[0] or 0) // at_once))
    seeds = staged(seeds.withColumn("pass", F.pmod(F.xxhash64("item"), F.lit(n_passes))), "seeds")
    found = union_all([
        passages(docs, spark.sparkContext.broadcast(Seeds(seeds.where(F.col("pass") == i).collect(), bits))) for i in range(n_passes)
    ])
    pairs = found.join(test.select("item", "item_id", F.col("words").alias("item_words")), "item")
    pairs = pairs.select("doc_id", "text_hash", "item_id", "start", "item_words", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_hash, item, start, own, words in zip(*(c.to_pylist() for c in batch.columns)):
                score, first, last = align(own, words)
                if score >= max(least * len(own) - 1e-9, min(floor, len(own))):
                    rows.append({"doc_id": doc, "text_hash": text_hash, "item_id": item, "score": score / len(own), "start": start + first, "end": start + last})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()),
            ]))

    scored = pairs.mapInArrow(run, "doc_id long, text_hash long, item_id long, score double, start long, end long")
    best = scored.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.s")).alias("start"), F.col("b.end").alias("end"), "text_hash")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all their columns, without those that hold a test item."""
    found = decontaminate(docs, items).select("doc_id", "text_hash").distinct()
    return without(docs, found.withColumn("kept", F.lit(False)))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "start", "end")
