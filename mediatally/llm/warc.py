r"""WARC archives: written as text with CRLF CRLF between records, read back by verified chains of record boundaries.

Writing. Payloads are grouped by digest; of equal ones the smallest page id is a response record, the others are revisit
records that refer to it and hold the HTTP head alone. Only payloads whose digest hits a bitmap of the repeated digests (of
fixed size, so it is broadcast) are moved to be joined. Spark's text writer puts the record end behind each row, so every
part file is an archive, in whatever store the folder is.

Reading. Spark's text reader splits archives of any size at the magic line, wherever it stands, in payloads too. Each task
turns its byte range into candidates: an offset, and the successor's offset that the Content-Length there implies. Within
its range it also contracts chains, so that each candidate knows the first offset beyond the range that its chain leads
to. Only the ranges are then left to be linked: pointer jumping from the start of each file, over a table with a few rows
per range, doubles the reach of every pointer per round, and gives each range the one offset at which the file's true chain
enters it. Candidates on the chain from there are records; a magic line inside a payload is on no such chain, even when a
whole record is quoted there. Payloads that do hold the magic arrive in pieces and are put together again from a second
scan, which runs only if there are any.

Byte ranges bound what a task holds (their candidates, never their payloads); nothing depends on the number of records of
a file. All tables go to the shared folder.

Defined results: a null payload counts as empty; empty payloads are equal to each other; rows that repeat with the same id
and payload are all response or all revisit records; a null id is written as an empty one and read back as null; line breaks
and the magic in a url are written percent-encoded; a payload under `least` bytes is never a revisit; an empty table gives
an empty archive and no rows; other columns are not read. A damaged archive ends at the damage: later records of the file
are not reachable. A header that itself holds the magic line is not recognised (none is written).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediatally.llm.common import bitmap, or_empty, small_batches, staged, table, with_hits
from mediatally.session import new_stage

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

HEAD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", bits: int = 1 << 24) -> None:
    """One record per row of page_id, url, html, into part files of the folder."""
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"), F.col("page_id").cast("long").alias("page_id"),
        F.replace(F.replace(F.replace(or_empty("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("WARC/1.0"), F.lit("WARC%2F1.0")).alias("url"),
        or_empty("html").alias("payload"),
    )
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), or_empty("html").alias("p"))
    narrow = narrow.select("page_id", base32_sha1(F.col("p")).alias("digest"), F.octet_length("p").alias("bytes")).where(F.col("bytes") >= least)
    firsts = narrow.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    firsts = staged(firsts.select("digest", "first"), "warc-firsts")
    # Payloads whose digest misses the bitmap of repeated digests are equal to no other, so they need not move.
    slot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    rows = with_hits(rows.withColumn("slot", slot), bitmap(firsts.select(slot.alias("slot")), bits), "shared")
    alone = rows.where("not shared").withColumn("first", F.lit(None).cast("long"))
    rows = alone.unionByName(rows.where("shared").join(firsts, "digest", "left"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("bytes") >= least)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("id"), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(folder)


def head_of(segment: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a record's header and its length, if the bytes behind a magic line are one."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields, at, end = {}, 0, end + 2
    while at < end:
        m = HEAD.match(segment, at, end)
        if not m:
            return None
        fields.setdefault(m[1].decode("ascii").lower(), m[2].decode("utf-8", "replace").strip())
        at = m.end()
    return (fields, end + 2) if fields.get("content-length", "").isdecimal() and "warc-type" in fields else None


def http_parts(block: bytes) -> tuple[int | None, bytes]:
    """The payload length that the HTTP head states, and the payload that follows."""
    head, _, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
    return (int(m[1]) if m else None), payload


def record_of(fields: dict[str, str], block: bytes) -> dict:
    """What is kept of a record whose block is whole."""
    stated, payload = http_parts(block)
    page, refers = (re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    if fields["warc-type"] == "revisit":  # the payload is with the record it refers to
        digest, n = fields.get("warc-payload-digest", "").removeprefix("sha1:"), stated
    return {
        "page_id": int(page[1]) if page else None, "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload_bytes": n, "payload_digest": digest, "refers_to": int(refers[1]) if refers else None,
    }


BITS = 1 << 22  # of the bitmap of segments that belong to cut payloads
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
# rel, next, leaves: offsets relative to the range's first segment; size: the segment with the magic behind it.
CANDIDATE = f"file string, range long, place long, rel long, size long, next long, leaves long, whole boolean, {RECORD}"


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """What stands between magic lines, in order within each byte range of each file."""
    raw = spark.read.option("lineSep", MAGIC).text(folder)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))


def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, int, bytes]]:
    """(file, range), place in the range, offset in it, segment."""
    key, place, rel = None, 0, 0
    for batch in batches:
        for segment, file, start in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != key:
                key, place, rel = (file, start), 0, 0
            yield key, place, rel, segment
            place, rel = place + 1, rel + len(segment) + len(MAGIC)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A row per segment: a candidate where a header follows the magic, with its successor and where its chain leaves the range."""
    schema = pa.schema([
        ("file", pa.string()), ("range", pa.int64()), ("place", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("next", pa.int64()),
        ("leaves", pa.int64()), ("whole", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
    ])

    def closed(rows: list[dict]) -> pa.RecordBatch:
        leaves: dict[int, int] = {}
        for row in reversed(rows):  # a successor always lies behind, so it is settled before
            if row["next"] is not None:
                row["leaves"] = leaves[row["rel"]] = leaves.get(row["next"], row["next"])
        return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in schema.names}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        now = None
        for key, place, rel, segment in in_ranges(batches):
            if key != now and rows:
                yield closed(rows)
                rows = []
            now = key
            row = {"file": key[0], "range": key[1], "place": place, "rel": rel, "size": len(segment) + len(MAGIC), "next": None, "leaves": None, "whole": False}
            if (place or key[1]) and (head := head_of(segment)):
                fields, at = head
                end = at + int(fields["content-length"])
                row["next"] = rel + end + len(END) + len(MAGIC)
                if len(segment) >= end:
                    row |= {"whole": True, **record_of(fields, segment[at:end])}
            rows.append(row)
        if rows:
            yield closed(rows)

    return segments(spark, folder).mapInArrow(run, CANDIDATE)


def ranges_of(rows: DataFrame) -> DataFrame:
    """file, range, base (the offset in the file of its first segment), end; a few rows per file."""
    sizes = rows.groupBy("file", "range").agg(F.sum("size").alias("total"))
    return sizes.selectExpr(
        "file", "range", "total", "sum(total) over (partition by file order by range) - total as base",
    ).select("file", "range", "base", (F.col("base") + F.col("total")).alias("end"))


def entries(rows: DataFrame) -> DataFrame:
    """file, range, entry: the offset in the range at which the chain from the start of its file enters it.

    `rel` of a segment counts from the range's first segment, and its magic stands just before it.
    """
    ranges = ranges_of(rows)
    # The chain that enters a range at a candidate leaves it for `leaves`, which lies in a later range.
    heads = rows.where("next is not null").join(ranges, ["file", "range"]).select(
        "file", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("leaves")).alias("to"),
    )
    # Only candidates that some chain enters a range at matter: the targets, and the first record of each file.
    first = rows.where("place = 0 and range = 0").select("file", F.col("size").alias("at"))
    targets = heads.select("file", F.col("to").alias("at")).unionByName(first).distinct()
    jump = staged(targets.join(heads, ["file", "at"]), "warc-jumps")
    reached, n = staged(first.withColumn("new", F.lit(True)), "warc-reached"), -1
    while n != (n := reached.count()):
        step = jump.select("file", "at", "to")
        more = reached.join(step, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = staged(reached.select("file", "at").unionByName(more).distinct(), "warc-reached")
        jump = staged(step.join(step.select("file", F.col("at").alias("to"), F.col("to").alias("beyond")), ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "warc-jumps")
    # The range of an offset is the last one that begins no later: one ordered pass over a file's few rows per range.
    ends = ranges.select("file", F.col("base").alias("at"), F.lit(0).alias("kind"), "range", "base", "end")
    both = ends.unionByName(reached.select("file", "at", F.lit(1).alias("kind")), allowMissingColumns=True)
    before = Window.partitionBy("file").orderBy("at", "kind", "range").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("file", "at", "kind", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("range", "base", "end")])
    found = both.where("kind = 1 and at < end")
    # A chain that breaks points into the range it is in; where it came in lies before.
    return found.groupBy("file", "range", "base").agg(F.min(F.col("at") - F.col("base")).alias("entry"))


OWNED = f"file string, range long, place long, offset long, owner long, whole boolean, starts boolean, {RECORD}"


def retained(rows: DataFrame) -> DataFrame:
    """The segments with the record they belong to (`owner`, null before the first one of the range); records start where
    `starts`. One group is one byte range."""
    names = [c.split()[0] for c in OWNED.split(", ")]

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rel", kind="stable").reset_index(drop=True)
        starts, owner, wanted, now = [], [], group["entry"].iloc[0], None
        for rel, after in zip(group["rel"], group["next"]):
            hit = not pd.isna(wanted) and rel == wanted and not pd.isna(after)
            if hit:
                now, wanted = rel, after
            starts.append(hit)
            owner.append(now)
        base = group["base"].iloc[0]
        group["starts"], group["offset"] = starts, group["rel"] + base - len(MAGIC)
        group["owner"] = pd.array([None if o is None else int(o + base - len(MAGIC)) for o in owner], dtype="Int64")
        return group[names]

    ranges = ranges_of(rows).select("file", "range", "base")
    placed = rows.join(ranges.join(entries(rows).select("file", "range", "entry"), ["file", "range"], "left"), ["file", "range"])
    return placed.groupBy("file", "range").applyInPandas(mark, OWNED)


def put_together(spark: SparkSession, folder: str, owned: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces from a second scan, joined in order."""
    # Pieces before the first record of a range belong to the last record of the ranges before.
    last = owned.where("starts").groupBy("file", "range").agg(F.max("offset").alias("last"))
    carried = (
        owned.select("file", "range").distinct().join(last, ["file", "range"], "left")
        .selectExpr("file", "range", "max(last) over (partition by file order by range rows between unbounded preceding and 1 preceding) as before")
    )
    pieces = owned.join(carried, ["file", "range"]).select("file", "range", "place", "offset", F.coalesce("owner", "before").alias("owner"))
    broken = owned.where("starts and not whole").select("file", F.col("offset").alias("owner"))
    pieces = pieces.join(broken, ["file", "owner"], "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (file, start), place, _, segment in in_ranges(batches):
            held.append((file, start, place, segment))
            size += len(segment) + 64
            if size > 1 << 22:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["file", "range", "place", "segment"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(0).to_pylist():
                whole = MAGIC.encode().join(p["segment"] for p in parts)
                fields, at = head_of(whole)
                if len(whole) >= (end := at + int(fields["content-length"])):  # else the archive was cut off
                    out.append(record_of(fields, whole[at:end]))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
            ]))

    texts = segments(spark, folder).mapInArrow(read, "file string, range long, place long, segment binary")
    # Segments that miss the bitmap of the wanted ones, which is of fixed size, do not move.
    slot = F.pmod(F.xxhash64("file", "range", "place"), F.lit(BITS)).alias("slot")
    texts = with_hits(texts.select("*", slot), bitmap(pieces.select(slot), BITS), "wanted").where("wanted").drop("wanted")
    found = texts.join(pieces, ["file", "range", "place"]).groupBy("file", "owner")
    found = found.agg(F.array_sort(F.collect_list(F.struct("offset", "segment"))).alias("parts"))  # one record's own bytes
    return found.select("parts").mapInArrow(parse, RECORD)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record that the chain from the start of its file reaches."""
    small_batches(spark)
    rows = staged(candidates(spark, folder), "warc-candidates")
    owned = staged(retained(rows), "warc-records")
    columns = [c.split()[0] for c in RECORD.split(", ")]
    found = owned.where("starts and whole").select(*columns)
    if owned.where("starts and not whole").limit(1).count():
        found = found.unionByName(put_together(spark, folder, owned).select(*columns))
    return found


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_stage(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages
), f as (
  select *, min(page_id) over (partition by payload) as first from p
)
select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31 as integer), 1)),
         'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from f
"""
