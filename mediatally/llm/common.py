"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatally.session import new_stage

# Rows per Arrow batch: texts can be long, so a batch is kept small in bytes by keeping it small in rows.
BATCH_ROWS = 512


KEPT: dict = {}


def kept_in_worker(key: tuple, make: Callable):
    """What a Python worker keeps from task to task: the tables of one operator, those of the one before are let go."""
    if key not in KEPT:
        KEPT.clear()
        pa.default_memory_pool().release_unused()  # and what Arrow holds back from the batches of that operator
        KEPT[key] = make()
    return KEPT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back: lineage ends there, lost executors redo nothing before."""
    spark = df.sparkSession
    path = new_stage(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id", hashed: bool = False) -> DataFrame:
    """Key and whole text alone (`hashed`: and the text's hash); a null text counts as empty. Other columns stay out."""
    whole = or_empty(f"`{text}`")
    more = [F.xxhash64(whole).alias("text_hash")] if hashed else []
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), whole.alias("text"), *more)


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rank_file(path: str) -> dict[bytes, int]:
    """Merge ranks of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


PIECE = 4096 * 8  # bits in a piece of a bitmap


def bitmap(slots: DataFrame, bits: int) -> DataFrame:
    """The numbers of column `slot` (0 to bits - 1) as a bitmap in pieces of 4 KB: bits / 8 bytes in all, however many there are."""
    pieces = slots.groupBy((F.col("slot") / F.lit(PIECE)).cast("long").alias("piece"))
    return pieces.agg(F.bitmap_construct_agg((F.col("slot") % PIECE).alias("at")).alias("held"))


def with_hits(rows: DataFrame, pieces: DataFrame, name: str) -> DataFrame:
    """The rows with a column that says whether their `slot` is in the bitmap, which is broadcast: its size is fixed."""
    at = F.col("slot") % PIECE
    byte = F.conv(F.hex(F.substring(F.col("held"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = rows.withColumn("piece", (F.col("slot") / F.lit(PIECE)).cast("long")).join(F.broadcast(pieces), "piece", "left")
    return joined.withColumn(name, hit).drop("piece", "held", "slot")


def without(docs: DataFrame, verdicts: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The documents, all their columns, without those that `verdicts` (doc_id, text_hash, kept: one row each) drops.

    Of rows that are equal in id and text as many stay as verdicts say, one or none. Rows whose key misses a bitmap of the
    affected keys, which is of fixed size and so broadcast, pass without being moved; the others are joined.
    """
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k_id"), F.col("text_hash").alias("k_text")]
    counts = verdicts.select(*key, F.col("kept").cast("int").alias("kept")).groupBy("k_id", "k_text")
    counts = counts.agg(F.max("kept").alias("stays"), F.sum("kept").alias("n_kept"), F.count("*").alias("n"))
    affected = staged(counts.where("n_kept < n").select("k_id", "k_text", "stays"), "affected")
    slot = F.pmod(F.xxhash64("k_id", "k_text"), F.lit(bits))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(or_empty("text")).alias("text_hash"),
    ).select("row", *key)
    rows = with_hits(rows.withColumn("slot", slot), bitmap(affected.select(slot.alias("slot")), bits), "hit")
    joined = rows.where("hit").join(affected, ["k_id", "k_text"], "left").where("stays is null or stays = 1")
    nth = F.when(F.col("stays").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    joined = joined.withColumn("nth", nth).dropDuplicates(["k_id", "k_text", "nth"])
    return rows.where("not hit").select("row.*").unionByName(joined.select("row.*"))
