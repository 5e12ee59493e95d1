"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical without the white space characters \\x20 and \\x09-\\x0D. The first scan reads
each text for its length and the hash of its first characters only. Rows whose length, and then whose length and prefix
hash, occur once are settled there. The keys that occur more often go into a bitmap of fixed size; the second scan hashes
the whole text of the rows that hit it. A false hit costs one hash, never a wrong group, and a full bitmap (a corpus far
larger than `bits`) only means that more texts are hashed in full.

Everything is DataFrame functions. Rows that move between tasks are narrow (key, counts, hashes), texts never move, and
every grouping has a partial aggregate, so a group with a third of all rows is one row per task.

Defined results: a null text counts as empty and equals any text of white space alone; of equal texts the one with the
most code points stays, then the smallest doc_id, a null doc_id last; of rows that repeat with the same doc_id one stays;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.llm.common import bitmap, staged, table, texts, with_hits, without

WHITE = r"[\x20\x09-\x0D]+"


def squeezed(text: Column) -> Column:
    """The text without white space, which is what is compared."""
    return F.regexp_replace(text, WHITE, "")


def first_look(docs: DataFrame, prefix: int) -> DataFrame:
    """Length and prefix hash of each text: one scan."""
    bare = squeezed(F.col("text"))
    return texts(docs).select(F.length(bare).alias("length"), F.xxhash64(F.left(bare, F.lit(prefix))).alias("prefix"))


def repeated_keys(looks: DataFrame) -> DataFrame:
    """Lengths that occur more than once, then, among their rows, the prefix hashes that do."""
    lengths = looks.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    again = looks.join(lengths, "length", "left_semi")
    return again.groupBy("length", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("length", "prefix")


def slot(length: Column, prefix: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(bits)).alias("slot")


def second_look(docs: DataFrame, pieces: DataFrame, prefix: int, bits: int, digest_all: bool) -> DataFrame:
    """Full hash of the texts that hit the bitmap, from a second scan; `digest_all` hashes the others as well."""
    bare = squeezed(F.col("text"))
    seen = texts(docs, hashed=True).select(
        "doc_id", "text_hash", F.length("text").alias("points"), bare.alias("bare"),
        slot(F.length(bare), F.xxhash64(F.left(bare, F.lit(prefix))), bits),
    )
    digest = F.sha2(F.col("bare"), 256)
    digest = digest if digest_all else F.when(F.col("shared"), digest)
    return with_hits(seen, pieces, "shared").select("doc_id", "text_hash", "points", "shared", digest.alias("text_sha256"))


def exact_dedup(docs: DataFrame, prefix: int = 64, bits: int = 1 << 24, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (null for settled rows unless `digest_all`), and
    text_hash of the text as it is."""
    looks = staged(first_look(docs, prefix), "exact-looks")
    pieces = bitmap(repeated_keys(looks).select(slot(F.col("length"), F.col("prefix"), bits)), bits)
    rows = staged(second_look(docs, pieces, prefix, bits, digest_all), "exact-rows")
    alone = rows.where("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "text_hash")
    same = rows.where("shared").groupBy("text_sha256", "doc_id", "points", "text_hash").agg(F.count("*").alias("copies"))
    groups = same.groupBy("text_sha256").agg(
        F.sum("copies").alias("group_size"), F.max(F.struct("points", (-F.col("doc_id")).alias("id"), "text_hash")).alias("best"),
    )
    found = same.join(groups, "text_sha256")
    stays = (F.col("points") == F.col("best.points")) & F.col("doc_id").eqNullSafe(-F.col("best.id")) & (F.col("text_hash") == F.col("best.text_hash"))
    found = found.select(
        "doc_id", (-F.col("best.id")).alias("keep_id"), "group_size", stays.alias("stays"), "text_sha256", "text_hash",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    found = found.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "text_hash")
    return alone.unionByName(found)


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, one of each group of equal texts."""
    return without(docs, exact_dedup(docs).select("doc_id", "text_hash", "kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents
), r as (
  select *, row_number() over (partition by bare order by points desc, doc_id) as place from d
)
select doc_id, first_value(doc_id) over (partition by bare order by place) as keep_id,
       count(*) over (partition by bare) as group_size, place = 1 as kept, sha256(bare) as text_sha256
from r
"""
