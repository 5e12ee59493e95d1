"""Groups of spelling variants, found in tries of letter counts.

Words are arranged by the counts of successive letter groups: a node at depth d is reached by the counts of the first d
groups, a leaf holds the words that agree in all of them. One inserted letter adds one to one count, a deleted one takes
one away, a replaced one does both or stays in its group: a search carries a surplus and a deficit of one each, follows
only the counts that these allow, and verifies the words of the leaves it reaches.

1. Runs of letters are counted per batch, then by Spark with partial counts before the shuffle.
2. The counts of the first `depth` groups name a shard; `depth` grows until no shard holds more than `shard_words` words,
   or until all groups are used. A word is a query to its own shard and to those that its budget can reach; of two shards
   one asks the other, so every pair is found once.
3. A task holds one shard's trie as flat arrays and takes the queries through it some thousands at a time, all letter
   groups in turn.
4. The most frequent near word is the form of a word if it is frequent enough; forms are followed by pointer jumping. A form
   has `ratio` times its word's count, so chains are short, whatever the corpus.

Defined results: a null or empty text has no words; a null id counts as empty in the checksum that marks runs; rows with
the same id and repeated rows all count; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import small_batches, staged, table, texts

# Bytes of Latin-1 as words need them: capitals lower-cased, letters as they are, all others (? for what is beyond) a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
DROPS = 199  # one run of so many loses a letter
GROUPS = 16
MOST = 1 << 31  # above any count of letters
AT_ONCE = 1 << 13  # queries that go through a trie together


def letter_groups(groups: int = GROUPS) -> np.ndarray:
    """The group of each letter (code points up to 255): common letters are dealt in turn, others by their number."""
    common = b"eainrtoslucdhmpgbfvk"  # fixed values: letters by how common they are, roughly
    out = np.arange(256) % groups
    out[np.frombuffer(common, np.uint8)] = np.arange(len(common)) % groups
    return out


def counted_words(docs: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """word, n: the words of the documents, with one letter of the marked runs left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[bytes] = Counter()
            for id_, text in zip(*(c.to_pylist() for c in batch.columns)):
                seed = crc32(f"{'' if id_ is None else id_}:".encode())
                runs = [r for r in text.encode("latin-1", "replace").translate(LETTERS).split() if len(r) >= least_length]
                total.update(runs)
                for word in set(runs):
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % DROPS == 0:
                        n, at = runs.count(word), h % len(word)
                        total[word] -= n
                        if len(word) > least_length:
                            total[word[:at] + word[at + 1 :]] += n
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    small_batches(docs.sparkSession)
    counted = texts(docs).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Words:
    """Words as one array of letters, with their letter counts by group."""

    def __init__(self, words: list[str]):
        data = [w.encode("latin-1") for w in words]
        self.sizes = np.fromiter(map(len, data), np.int64, len(data))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(data), np.uint8)
        letters = np.concatenate([self.letters, np.zeros(3, np.uint8)]).astype(np.uint32)
        three = letters[:-2] | letters[1:-1] << np.uint32(8) | letters[2:] << np.uint32(16)
        self.heads, self.tails = three[self.starts], three[np.maximum(self.starts + self.sizes - 3, 0)]
        at = np.repeat(np.arange(len(data)) * GROUPS, self.sizes) + letter_groups()[self.letters]
        self.counts = np.bincount(at, minlength=len(data) * GROUPS).reshape(-1, GROUPS)

    def taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[numbers], self.sizes[numbers]


class Trie:
    """The nodes of each depth, numbered, under the sorted keys of (parent, count); words in the order of their leaves."""

    def __init__(self, words: Words):
        self.order = np.lexsort(words.counts.T[::-1])
        ordered = words.counts[self.order]
        node = np.zeros(len(ordered), np.int64)
        self.keys: list[np.ndarray] = []
        for level in range(GROUPS):
            keys, node = np.unique(node * MOST + ordered[:, level], return_inverse=True)
            self.keys.append(keys)
        self.first = np.searchsorted(node, np.arange(len(self.keys[-1]) + 1))

    def reached(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and leaf of each search that keeps to a surplus and a deficit of one, and ends no shorter than it began."""
        query = np.arange(len(counts))
        node, surplus, deficit = (np.zeros(len(counts), np.int64) for _ in range(3))
        for level, keys in enumerate(self.keys):
            parts = []
            for step in (0, 1, -1):
                open_ = slice(None) if not step else np.flatnonzero((surplus if step > 0 else deficit) == 0)
                key = node[open_] * MOST + np.maximum(counts[query[open_], level] + step, -1)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                parts.append((query[open_][hit], at[hit], surplus[open_][hit] + (step > 0), deficit[open_][hit] + (step < 0)))
            query, node, surplus, deficit = (np.concatenate(p) for p in zip(*parts))
        fits = surplus >= deficit
        return query[fits], node[fits]


def shared_letters(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many letters agree from positions `at` and `bt` on, onwards or backwards, `most` at the most."""
    found, left = np.zeros(len(at), np.int64), np.arange(len(at))
    k = 0
    while len(left):
        left = left[most[left] > k]
        left = left[a[at[left] + step * k] == b[bt[left] + step * k]]
        k += 1
        found[left] = k
    return found


def near(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word j of b is word i of a with one letter replaced or inserted."""
    # One edit leaves the first or the second half of the shorter word as it is.
    open_ = (a.sizes[i] < 6) | (a.heads[i] == b.heads[j]) | (a.tails[i] == b.tails[j])
    out, i, j = np.zeros(len(i), bool), i[open_], j[open_]
    (start, size), (other, longer) = a.taken(i), b.taken(j)
    front = shared_letters(a.letters, start, b.letters, other, size, 1)
    back = shared_letters(a.letters, start + size - 1, b.letters, other + longer - 1, size - np.minimum(front, size), -1)
    out[open_] = np.where(size == longer, front + back == size - 1, (longer == size + 1) & (front + back >= size))
    return out


def paths(words: DataFrame, depth: int) -> DataFrame:
    """word, n, path (counts of the first groups), asks (the other paths that it may find words under)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = Words(batch.column(0).to_pylist()).counts[:, :depth].tolist()
            asks = []
            for top in tops:
                own = []
                for i in range(depth):
                    more = [*top[:i], top[i] + 1, *top[i + 1 :]]
                    own.append(more)
                    own += [[*more[:j], more[j] - 1, *more[j + 1 :]] for j in range(i + 1, depth) if more[j]]
                asks.append([",".join(map(str, p)) for p in own])
            names = [",".join(map(str, p)) for p in tops]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(asks, pa.list_(pa.string()))], ["word", "n", "path", "asks"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, path string, asks array<string>")


def found_pairs(held: pa.Table, asking: pa.Table) -> Iterator[pa.Table]:
    words = Words(held["word"].to_pylist())
    trie = Trie(words)
    for at in range(0, asking.num_rows, AT_ONCE):
        part = asking.slice(at, AT_ONCE)
        queries = Words(part["word"].to_pylist())
        query, leaf = trie.reached(queries.counts)
        sizes = trie.first[leaf + 1] - trie.first[leaf]
        for cut in np.split(np.arange(len(leaf)), np.searchsorted(np.cumsum(sizes), np.arange(1 << 20, int(sizes.sum()) + 1, 1 << 20))):
            n = sizes[cut]
            i = np.repeat(query[cut], n)
            j = trie.order[np.repeat(trie.first[leaf[cut]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            fits = queries.sizes[i] <= words.sizes[j]
            i, j = i[fits], j[fits]
            ok = near(queries, i, words, j)
            a, b = part.take(pa.array(i[ok])), held.take(pa.array(j[ok]))
            # Words of one shard ask each other: of two words of one length the smaller asks.
            once = [not own or len(x) < len(y) or x < y for own, x, y in zip(a["own"].to_pylist(), a["word"].to_pylist(), b["word"].to_pylist())]
            yield pa.table([a["word"], a["n"], b["word"], b["n"]], ["word", "n", "other", "other_n"]).filter(pa.array(once, pa.bool_()))


def near_pairs(words: DataFrame, shard_words: int) -> DataFrame:
    """word, n, other, other_n: every pair of words that one inserted, deleted or replaced letter sets apart, once."""
    for depth in range(1, GROUPS + 1):
        largest, n = paths(words, depth).groupBy("path").count().agg(F.max("count"), F.sum("count")).first()
        if (largest or 0) <= shard_words:
            break
    shards = paths(words, depth)
    asking = shards.select("word", "n", "path", F.lit(True).alias("own")).unionByName(
        shards.select("word", "n", F.explode("asks").alias("path"), F.lit(False).alias("own"))
    )

    def run(key: tuple, held: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])
        if not held.num_rows or not queries.num_rows:
            return schema.empty_table()
        return pa.concat_tables([schema.empty_table(), *(t.cast(schema) for t in found_pairs(held, queries))])

    tasks = 1 + 8 * (n or 0) // shard_words  # tries take time, not space: no merging of small partitions
    held, asking = (t.repartition(tasks, "path") for t in (shards.select("word", "n", "path"), asking))
    return held.groupBy("path").cogroup(asking.groupBy("path")).applyInArrow(run, "word string, n long, other string, other_n long")


def followed(forms: DataFrame, ratio: int) -> DataFrame:
    """word, root: forms followed to the last. A chain has fewer links than a long has digits in base `ratio`."""
    reach, roots = 1, forms.select("word", F.col("form").alias("root"))
    while ratio**reach < 1 << 63:
        roots = staged(roots, "spelling-roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = staged(roots.join(onward, "root", "left"), "spelling-steps")
        roots = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.where("further is not null").isEmpty():
            break
        reach *= 2
    return roots


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, shard_words: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of at least `least_length` letters that occurs `least_count` times."""
    words = staged(counted_words(docs, least_length, least_count), "spelling-words")
    pairs = staged(near_pairs(words, shard_words), "spelling-pairs")
    links = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))

    def best(by: Column) -> Column:
        return F.min(F.struct((-by).alias("n"), F.col("other").alias("form")))

    grouped = links.groupBy("word").agg(F.count("*").alias("n_near"), best(F.col("other_n")).alias("best"), F.max("n").alias("own"))
    strong = -F.col("best.n") >= ratio * F.col("own")
    forms = grouped.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"))
    forms = staged(forms, "spelling-forms")
    roots = followed(forms.where("form is not null"), ratio)
    found = words.join(forms, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
