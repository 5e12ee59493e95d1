"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands side by side inside no token of the vocabulary can never be merged across, so a cut between
the two is certain. Each word is cut at all such pairs, the fragments are encoded independently and the pieces are
concatenated. White space is the most frequent cut of that kind for this vocabulary: no token holds any, so a text is
first split there, and the encodings of short pieces between white space, and of their words, are kept in a table of a
fixed number of bytes (two generations, the older one forgotten when the younger is full), because they repeat.

The vocabulary is a tokenizers JSON file with a BPE model that has an end-of-word suffix, lower-cases, and drops white
space. Its path is a parameter; nothing is trained. Every text is handled alone, in one pass over the rows without any
shuffle, so the work is as even as the input's partitions and a lost task is redone from its own rows.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; the strings of
special tokens in a text become their ids, as in the tokenizers library; rows that repeat are encoded each; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from operator import add
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import kept_in_worker, small_batches, table, texts

KEPT_BYTES = 32 << 20  # encodings kept in a worker, and as much of the generation before
KEPT_LENGTH = 64  # longer pieces hardly repeat and are not kept
ENTRY = 120  # bytes of a table's entry beside key and value
SHORT = 24  # up to so many symbols the merges are found by scanning, beyond by a heap
NEVER = 1 << 60  # rank of a pair that is not merged

# The word pattern of the vocabulary, and its white space (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SPACES = re.compile(f"[{SPACE}]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the vocabulary
SUFFIX = "</w>"


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Kept(dict):
    """Results of `make` by key, those of long keys apart; at most twice `most` bytes of them."""

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT_BYTES):
        super().__init__()
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > KEPT_LENGTH:
            return self.make(key)
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        size = getsizeof(key) + getsizeof(found) + ENTRY
        if self.held + size > self.most:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = found
        self.held += size
        return found


class Vocabulary:
    """Encodes texts to the bytes of 32-bit ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): i for i, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)])
        self.letters = dict(enumerate(byte_letters()))
        self.inside = self._inside()
        self.pieces = Kept(self.encode_piece)

    def _inside(self) -> set[str]:
        """All pairs of letters that occur side by side in some token; any other pair is a forced boundary."""
        pairs = set()
        for token in self.ids:
            word = token.removesuffix(SUFFIX) or token
            pairs.update(map(add, word, word[1:]))
        return pairs

    def fragments(self, word: str) -> list[str]:
        """The word cut at its forced boundaries."""
        if self.inside.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        rank = self.ranks.get
        found = [rank(p, NEVER) for p in zip(symbols, symbols[1:])]
        while found and (best := min(found)) < NEVER:
            i = found.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i:
                found[i - 1] = rank((symbols[i - 1], symbols[i]), NEVER)
            if i < len(found):
                found[i] = rank((symbols[i], symbols[i + 1]), NEVER)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap over a linked list, for fragments of any length."""
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (rank := self.ranks.get((symbols[i], symbols[after[i]]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[after[i]]))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] else -1
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s]

    def encode_piece(self, piece: str) -> bytes:
        """A piece between white space; one of several words is put together from theirs."""
        words = [piece] if piece.isalpha() else WORDS.findall(piece)
        return self.encode_word(piece) if len(words) == 1 else b"".join(map(self.pieces.__getitem__, words))

    def encode_word(self, word: str) -> bytes:
        parts = self.fragments(word.encode("utf-8").decode("latin-1").translate(self.letters))
        out = []
        for part in parts[:-1]:
            out += map(self.ids.__getitem__, self.merged(list(part)))
        last = list(parts[-1])
        last[-1] += SUFFIX
        out += map(self.ids.__getitem__, self.merged(last))
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as the bytes of 32-bit integers."""
        if self.special and self.special_pattern.search(text):
            out, at = [], 0
            for m in self.special_pattern.finditer(text):
                out += [self._plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # One letter at a time: a capital sigma at the end of a word does not become a final sigma here.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        pieces = [p for p in SPACES.split(text) if p] if NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The names of the ids joined by a space: the vocabulary names no decoder, special tokens are kept."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")


def vocabulary_of(path: str) -> Vocabulary:
    """One per worker: later tasks of the worker find its tables filled."""
    return kept_in_worker(("bpe", path), lambda: Vocabulary(path))


def encode_batch(vocabulary: Vocabulary, text: pa.Array) -> pa.ListArray:
    found = [vocabulary.encode(t) for t in text.to_pylist()]
    ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encode_batch(vocabulary, batch.column(1))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of each list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            ids = batch.column(1)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int32)), ids.flatten())
            yield pa.RecordBatch.from_arrays([batch.column(0), vocabulary.decode(ids)], ["doc_id", "decoded"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for batch in batches:
            ids = encode_batch(vocabulary, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, vocabulary.decode(ids)], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of the ids and of the decoded text."""
    return round_trip(docs, path).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
