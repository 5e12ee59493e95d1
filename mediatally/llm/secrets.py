r"""Secret scan: fixed formats, and strings that a public vocabulary cannot say in few tokens.

Three formats are found by pattern: assignments to a name like password or token, access keys, and long runs of hex
digits. The token-efficiency test finds what no format describes: a run of at least MIN_RANDOM characters of the base64
alphabets is encoded with a tiktoken vocabulary; words come to three or four characters a token, random strings to less
than two. Runs that are known digests (hex of a usual digest length) or identifiers (UUIDs, plain numbers, names made of
words, file paths) are set aside first, and so are runs that a format has found already.

Each text is handled alone in one pass, without a shuffle. Cheap tests (does a keyword occur, is any piece between white
space long enough) decide which patterns run at all; they never change the result.

Defined results: a null text counts as empty and has no spans; offsets count code points, ends are exclusive; rows that
repeat are scanned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import kept_in_worker, rank_file, small_batches, table, texts

# The formats of the contract, in its order of kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MIN_RANDOM = 20
RUN = re.compile(r"[A-Za-z0-9+/=_-]+")
BETWEEN = re.compile(r"[^/_=-]+")  # parts of a run
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+/=_-]+"  # numbers, dates, rules
    r"|(?:[A-Z]?[a-z]+|[A-Z]+)(?:[/_-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+[/_-]?"  # names and paths made of words
    r"|(.)\1+",  # one character repeated
    re.DOTALL,
)
LETTERS_ALONE = 0.95  # of the ratio, for runs without digits
PART = 2048  # characters encoded at once, so that a run of any length takes time in proportion

Span = tuple[str, int, int]


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    make = lambda: tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=rank_file(path), special_tokens={})
    return kept_in_worker(("secrets", path, pattern), make)


def characters_per_token(run: str, vocabulary: tiktoken.Encoding) -> float:
    return len(run) / sum(len(vocabulary.encode_ordinary(run[i : i + PART])) for i in range(0, len(run), PART))


def is_random(run: str, vocabulary: tiktoken.Encoding, least: float) -> bool:
    """A run that takes more tokens than words would, and is neither a digest nor an identifier.

    Letters alone can be a word that the vocabulary does not know, so they must take more tokens still.
    """
    if len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    if not re.search("[A-Za-z]", run):
        return False
    return characters_per_token(run, vocabulary) < (least if re.search("[0-9]", run) else least * LETTERS_ALONE)


def random_parts(run: str, vocabulary: tiktoken.Encoding, least: float, shortest: int) -> list[tuple[int, int]]:
    """The run if it is random as a whole, else its random parts between separators."""
    if is_random(run, vocabulary, least):
        return [(0, len(run))]
    parts = [m for m in BETWEEN.finditer(run) if shortest <= len(m[0]) < len(run)]
    return [m.span() for m in parts if is_random(m[0], vocabulary, least)]


def formats(text: str, longest: int) -> list[Span]:
    """Spans of the fixed formats; `longest` is the length of the longest piece between white space."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if longest >= 24:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def spans(text: str, vocabulary: tiktoken.Encoding, least: float, shortest: int = MIN_RANDOM) -> list[Span]:
    """All spans by start, then kind."""
    longest = max(map(len, text.split()), default=0)
    found = formats(text, longest)
    if longest >= shortest:
        taken = bytearray(len(text))
        for _, start, end in found:
            taken[start:end] = b"\1" * (end - start)
        for m in RUN.finditer(text):
            if m.end() - m.start() >= shortest and not any(taken[m.start() : m.end()]):
                found += [("random", m.start() + a, m.start() + b) for a, b in random_parts(m[0], vocabulary, least, shortest)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(docs: DataFrame, path: str, pattern: str, least: float = 2.0, shortest: int = MIN_RANDOM) -> DataFrame:
    """doc_id and its spans (kind, start, end). `least`: characters per token below which a run is random; `shortest`: the
    characters of the shortest run that is tested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoding(path, pattern)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t, vocabulary, least, shortest)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("random").alias("n_random"),
    )
