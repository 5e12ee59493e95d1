"""Readers for single tables, with the encoding fallback, and the Parquet sink for stage tables."""

from __future__ import annotations

import csv
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from mediatally.functions.markdown import strip_markdown
from mediatally.operators.missing import nulls_for_nans
from mediatally.session import new_stage, staged
from mediatally.sources.listing import LISTING_TASKS, contents_on_disk, files_on_disk, folder_on_disk

LATIN = "ISO-8859-1"
# JSON text that one task sorts at a time, as pieces or as their places, and how many pieces a range has at most.
TASK_BYTES, RANGE_PIECES = 32 << 20, 1 << 17
# Names of files that are text as they are.
PLAIN_NAME = r"\.(txt|md|markdown)$"


def invalid_utf8_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(path) of files holding a line that is not valid UTF-8.

    Lines are checked where they are read, so large files are split over tasks like any other scan.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    return (
        lines.select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("ok"))
        .where(~F.col("ok")).select("path").distinct()
    )


# Cells that count as missing in a CSV file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
]

# What a cell can be, as bits; each cell is one of them, and a column's type follows from those that occur in it.
WHOLE, NUMBER, TRUTH, DATE, TIME, TEXT = (1 << k for k in range(6))
TYPES_OF = {WHOLE: "bigint", NUMBER: "double", WHOLE | NUMBER: "double", TRUTH: "boolean", DATE: "date", TIME: "timestamp"}


def cell_kind(c: Column) -> Column:
    """The bit of a cell; null for a null. Patterns decide, because a failing cast is slow, even a tried one."""
    def fits(kind: str, bit: int, else_: int = TEXT) -> Column:
        return F.when(c.try_cast(kind).isNotNull(), F.lit(bit)).otherwise(F.lit(else_))

    whole = F.when(F.length(F.trim(c)) < 19, F.lit(WHOLE)).otherwise(fits("bigint", WHOLE, NUMBER))
    digits = (
        F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), whole).when(c.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.lit(NUMBER))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), fits("date", DATE)).when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), fits("timestamp", TIME))
        .otherwise(F.lit(TEXT))
    )
    word = F.when(F.lower(F.trim(c)).isin("true", "false"), F.lit(TRUTH)).when(c.rlike(r"(?i)^\s*([+-]?inf(inity)?|nan)\s*$"), F.lit(NUMBER))
    return F.when(c.rlike(r"^\s*[+-]?[0-9.]"), digits).when(c.isNotNull(), word.otherwise(F.lit(TEXT)))


class CsvFacts(NamedTuple):
    latin: bool  # a file is not UTF-8
    broken: bool  # a quoted cell holds a line break
    types: dict[str, str]
    latin_files: DataFrame | None = None  # (path) of the files that are not UTF-8


def literal_path(path: str) -> str:
    """The path with what Spark would take for wildcards escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def null_tokens(df: DataFrame) -> DataFrame:
    """Text cells that are a missing-value token become null."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    return df.select(*[(F.when(~q.isin(MISSING_TOKENS), q) if c in texts else q).alias(c) for c, q in quoted.items()])


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def column_names(cells: list[str]) -> list[str]:
    """Names for the cells of a header record: empty ones are numbered by position, repeated ones counted.

    Spark does not tell names apart by case, so neither does this.
    """
    taken: set[str] = set()
    names = []
    for i, cell in enumerate(cells):
        base = cell.strip("\ufeff") if cell.strip("\ufeff").strip() else f"unnamed_{i}"
        name, again = base, 0
        while name.lower() in taken:
            again += 1
            name = f"{base}_{again}"
        taken.add(name.lower())
        names.append(name)
    return names


def header_names(spark: SparkSession, path: str | list[str], recursive: bool = False) -> list[str]:
    """Column names from the first record of a file, read as data; stops at the first line that is not blank."""
    lines = spark.read.option("recursiveFileLookup", recursive).text(path).where(F.col("_metadata.file_block_start") == 0)
    plain = F.decode(F.col("value").cast("binary"), LATIN).alias("value")
    row = lines.select(plain).where(F.trim("value") != "").first()
    if row is None:
        raise ValueError(f"no header in {path}")
    cells = next(csv.reader([row.value]))
    if row.value.count('"') % 2:  # a name holds a line break
        cells = ["" if c is None else c for c in _csv_reader(spark, True, LATIN, recursive).option("header", False).csv(path).first()]
    return column_names([_unlatin(c) for c in cells])


def csv_facts(spark: SparkSession, path: str | list[str], width: int, recursive: bool = False) -> CsvFacts:
    """Encodings by file, quoted line breaks and column types (of c0, c1, ...) from one scan over all lines.

    Lines come from the CSV reader without cells or quotes, which leaves the first line of each file out by its position,
    whatever it says. The facts of each file are a stage table of one row per file. Types need a second aggregate only where
    a quoted cell holds a line break, because lines are no records then.
    """
    schema = _text_schema([f"c{i}" for i in range(width)])
    reader = _csv_reader(spark, False, LATIN, recursive).options(sep="\x01", quote="")
    lines = reader.schema("value string").csv(path).select("value", F.col("_metadata.file_path").alias("path"))
    cells = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"'})
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    valid = F.is_valid_utf8(F.encode("value", LATIN).cast("string"))
    parsed = lines.select("path", valid.alias("valid"), (quotes % 2 == 1).alias("odd"), cells.alias("cells"))
    # Cells are columns of their own before they are tested, so that no test evaluates them again.
    shown = _kinds(null_tokens(parsed.select("path", "valid", "odd", "cells.*")), schema.names)
    found = [F.bool_or(~F.col("valid")).alias("latin"), F.bool_or("odd").alias("broken"), *[F.bit_or(c).alias(c) for c in schema.names]]
    files = staged(shown.groupBy("path").agg(*found), "csv-facts")
    row = files.agg(F.bool_or("latin").alias("latin"), F.bool_or("broken").alias("broken"), *[F.bit_or(c).alias(c) for c in schema.names]).first()
    latin, broken = bool(row["latin"]), bool(row["broken"])
    if broken:
        records = null_tokens(_csv_reader(spark, True, LATIN, recursive).schema(schema).csv(path))
        row = _kinds(records, records.columns).agg(*[F.bit_or(c).alias(c) for c in records.columns]).first()
    types = {c: TYPES_OF.get(row[c], "string") for c in schema.names}
    return CsvFacts(latin, broken, types, files.where("latin").select("path"))


def _kinds(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: cell_kind(F.col(n)) for n in names})


def _csv_reader(spark: SparkSession, multiline: bool, encoding: str, recursive: bool) -> DataFrameReader:
    reader = spark.read.option("recursiveFileLookup", recursive)
    return reader.option("header", True).option("multiLine", multiline).option("escape", '"').option("encoding", encoding)


def _unlatin(name: str) -> str:
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return name


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    check_encoding: bool = True,
    multiline: bool | None = None,
    recursive: bool = False,
) -> DataFrame:
    """CSV with a header. Files that are not UTF-8 are read as Latin-1; missing-value tokens become null.

    Without a schema one checking pass finds encodings, quoted line breaks and types; then the data is read once. The header
    is the first record of each file, whatever it holds: unnamed columns are called after their position, repeated ones
    counted. With a schema there is no checking pass: see csv_records. ``recursive`` reads files at any depth.
    """
    if schema is not None:
        return csv_records(_csv_reader(spark, bool(multiline), "UTF-8", recursive), path, schema, check_encoding)
    names = header_names(spark, path, recursive)
    facts = csv_facts(spark, path, len(names), recursive)
    broken = facts.broken if multiline is None else multiline
    df = _csv_reader(spark, broken, LATIN if facts.latin else "UTF-8", recursive).schema(_text_schema(names)).csv(path)
    if facts.latin:
        df = _decoded_by_file(df, facts.latin_files)
    return _typed(df, dict(zip(names, facts.types.values())))


def csv_records(reader: DataFrameReader | DataStreamReader, path: str | list[str], schema: T.StructType | str, check_encoding: bool = True) -> DataFrame:
    """Records of known columns, each by itself, for a batch reader and a stream reader alike.

    A cell that is not UTF-8 is taken as Latin-1 (``check_encoding=False``: all files are known to be UTF-8), quotes within
    cells are doubled, missing-value tokens become null, and what does not fit its type is null. Cells with line breaks
    need a reader with the option ``multiLine``.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = reader.option("header", True).option("escape", '"').option("encoding", LATIN if check_encoding else "UTF-8")
    df = reader.schema(_text_schema(schema.names)).csv(path)
    if check_encoding:
        df = _decoded_by_cell(df)
    return _typed(df, {f.name: f.dataType.simpleString() for f in schema})


def _quoted(names: list[str]) -> dict[str, Column]:
    return {c: F.col("`" + c.replace("`", "``") + "`") for c in names}


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    df = null_tokens(df)
    return nulls_for_nans(df.select(*[
        (q if types[c] == "string" else F.trim(q).try_cast(types[c])).alias(c) for c, q in _quoted(df.columns).items()
    ]))


def _decoded_by_cell(df: DataFrame) -> DataFrame:
    """Cells read as Latin-1, which keeps every byte, as UTF-8 where that is what they are."""
    content = {c: F.encode(q, LATIN).cast("string") for c, q in _quoted(df.columns).items()}
    return df.select(*[F.when(F.is_valid_utf8(b), b).otherwise(q).alias(c) for (c, b), q in zip(content.items(), _quoted(df.columns).values())])


def _decoded_by_file(df: DataFrame, latin: DataFrame) -> DataFrame:
    """Cells read as Latin-1, as UTF-8 but in the files listed."""
    files = latin.select(F.col("path").alias("__file"), F.lit(True).alias("__latin"))
    marked = df.withColumn("__file", F.col("_metadata.file_path")).join(files, "__file", "left")
    return marked.select(*[F.when(F.col("__latin"), q).otherwise(F.encode(q, LATIN).cast("string")).alias(c) for c, q in _quoted(df.columns).items()])


def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, lines: bool = False, split_above: int = 128 << 20
) -> DataFrame:
    """JSON in one of three shapes: records, an object with ``data``, or one other object per file.

    ``data`` of a top-level object may be an array of records, an object of equally long arrays, or one record; records
    keep a field of that name. ``lines=True`` reads one JSON value per line, which lets Spark split large files; there an
    object counts as an envelope when ``data`` is all it holds. Otherwise files are read whole, one by a task, unless one
    has more than ``split_above`` bytes: then the records are found first (json_records), whose rows are the same.
    """
    source = path
    if cut := not lines and _largest_file(spark, path) > split_above:
        source = new_stage(spark, "json-records")
        records = json_records(spark, path)
        records.write.partitionBy(*records.columns[1:]).text(source)
    reader = spark.read.option("multiLine", not lines and not cut)
    reader = reader.schema(schema) if schema else reader
    df = reader.json(source)
    if "_corrupt_record" in df.columns and len(df.columns) == 1 or cut and not df.columns and _first_sign(spark, path) not in ("[", "{"):
        raise ValueError(f"no JSON records or objects in {path}")
    envelope = df.columns == ["data"] if lines else "data" in df.columns and _first_sign(spark, path) == "{"
    return nulls_for_nans(_unwrap(df) if envelope else df)


def _largest_file(spark: SparkSession, path: str | list[str]) -> int:
    """The size of the largest file, from the listing: contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, and the columns that folder names give): the records of JSON files, each on one line, in no order.

    A file is an array of records or holds objects one after the other; elements of an array that are null are left out, and
    so is a record that the end of the file cuts off. Many tasks read one file: its text is cut at closing braces, each
    piece tells how it changes the depth of brackets, if it begins in a string and if not, and these changes are summed in the
    byte range of a task or a part of it, then over the ranges of the file. A record ends where the depth is back at that of the
    array. Ranges and pieces are dealt by the bytes of all files: places shrink so well in a shuffle that tasks made even by
    what they read would hold too many.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))  # fewer would be dealt again
    by_range = lambda df: df.repartition(tasks, "__file", "__block")
    by_piece = lambda df: df.repartition(tasks, "__file", "__block", "__seq")
    text = spark.read.option("lineSep", "}").text(path)
    more = [c for c in text.columns if c != "value"]
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda c, signs: F.length(c) - F.length(F.translate(c, signs, ""))
    odd = count(plain, '"') % 2

    def change(inside: int) -> Column:
        outside = F.regexp_replace(F.concat(F.lit('"' * inside), plain), r'"[^"]*("|\z)', "")
        closed = F.when(odd == inside, 1).otherwise(0)  # the brace behind the piece, unless a string holds it
        return count(outside, "{[") - count(outside, "]}") - closed

    pieces = staged(text.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__seq"), F.col("_metadata.file_size").alias("__size"),
        (F.octet_length("value") + 1).alias("__bytes"), odd.alias("__odd"), change(0).alias("__out"), change(1).alias("__in"),
        F.ltrim(F.regexp_replace("value", "[\ufeff\r\n\t]", " ")).startswith("[").alias("__list"),
    ).withColumn("__block", F.struct("__start", F.expr(f"__seq div {RANGE_PIECES}").alias("__cut"))).drop("__start"), "json-pieces")
    block, upto = Window.partitionBy("__file", "__block").orderBy("__seq"), (Window.unboundedPreceding, 0)
    # Within a range: whether a string is open behind the piece and how deep it is, for both ways the range may begin.
    narrow = by_range(pieces.select("__file", "__block", "__seq", "__size", "__bytes", "__odd", "__out", "__in", "__list"))
    open_ = F.sum("__odd").over(block.rowsBetween(*upto)) % 2
    walked = narrow.withColumn("__open", open_).withColumn("__began", (F.col("__open") + F.col("__odd")) % 2)
    way = lambda inside: F.when(F.col("__began") == inside, F.col("__out")).otherwise(F.col("__in"))
    deep = [F.sum(way(e)).over(block.rowsBetween(*upto)).alias(f"__deep{e}") for e in (0, 1)]
    walked = staged(walked.select("__file", "__block", "__seq", "__size", "__bytes", "__open", "__list", *deep), "json-depths")
    # Over the ranges of a file, one row each: what is open and how deep it is where the range begins. Numbers and truths only,
    # so that the aggregate hashes: one that keeps texts or structs would sort all it reads.
    last = walked.groupBy("__file", "__block").agg(
        *[F.max_by(c, "__seq").alias(c) for c in ("__open", "__deep0", "__deep1")], F.min_by("__list", "__seq").alias("__list"),
        F.max("__seq").alias("__last"), F.max("__size").alias("__size"), F.sum("__bytes").alias("__bytes"),
    )
    ranges = Window.partitionBy("__file").orderBy("__block")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("__inside", F.coalesce(F.sum("__open").over(before), F.lit(0)) % 2)
    added = F.when(F.col("__inside") == 0, F.col("__deep0")).otherwise(F.col("__deep1"))
    file = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("__list").over(file)
    # No brace stands behind the last piece of a file unless its bytes add up so (3 are those of a byte order mark).
    braced = (F.sum("__bytes").over(file) - F.col("__size")).isin(0, -3)
    entry = last.withColumn("__added", added).select(
        "__file", "__block", "__inside", F.coalesce(F.sum("__added").over(before), F.lit(0)).alias("__depth"),
        F.when(first, 1).otherwise(0).alias("__level"), F.when(F.lead("__block").over(ranges).isNull() & ~braced, F.col("__last")).alias("__bare"),
    )
    depth = F.col("__depth") + F.when(F.col("__inside") == 0, F.col("__deep0")).otherwise(F.col("__deep1"))
    ends = (depth == F.col("__level")) & ~F.col("__seq").eqNullSafe(F.col("__bare")) & ((F.col("__open") + F.col("__inside")) % 2 == 0)
    # A piece's record is the number of ends before it, in its range and in those before.
    ended = by_range(walked).join(entry, ["__file", "__block"]).select("__file", "__block", "__seq", ends.cast("int").alias("__ends"))
    local = F.sum("__ends").over(block.rowsBetween(*upto)) - F.col("__ends")
    ended = staged(ended.withColumn("__local", local), "json-ends")
    counts = ended.groupBy("__file", "__block").agg(F.sum("__ends").alias("__n"))
    counts = counts.select("__file", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbers = by_range(ended).join(counts, ["__file", "__block"]).select("__file", "__block", "__seq", "__ends", (F.col("__before") + F.col("__local")).alias("__record"))
    own = F.array_sort(F.collect_list(F.struct("__block", "__seq", "value")))  # one record's own bytes
    found = by_piece(pieces).join(by_piece(numbers), ["__file", "__block", "__seq"]).groupBy("__file", "__record", *more).agg(own.alias("__own"), F.max("__ends").alias("__ends"))
    whole = F.concat(F.array_join(F.col("__own.value"), "}"), F.lit("}"))
    lead = r"^[\s\ufeff\[,]*(null\s*,\s*)*"
    return found.where("__ends = 1").select(F.regexp_replace(F.regexp_replace(whole, lead, ""), r"[\r\n]+", " ").alias("value"), *more)


def _first_sign(spark: SparkSession, path: str | list[str]) -> str | None:
    """The first character of a JSON document that is not blank; stops at the first line that has one."""
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select(F.ltrim("value").alias("value"))
    row = lines.where("value <> ''").first()
    return row.value.lstrip("\ufeff \t\r\n")[:1] if row else None


def _unwrap(df: DataFrame) -> DataFrame:
    kind = df.schema["data"].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return df.select(F.inline("data"))
    if isinstance(kind, T.StructType) and all(isinstance(f.dataType, T.ArrayType) for f in kind):
        zipped = F.arrays_zip(*[F.col(f"data.`{f.name}`") for f in kind])
        return df.select(F.inline(zipped)).toDF(*[f.name for f in kind])
    if isinstance(kind, T.StructType):
        return df.select("data.*")
    return df


def decoded(content: Column) -> Column:
    """Text from raw text bytes: UTF-8 when valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content), content).otherwise(F.decode(content.cast("binary"), LATIN))


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, text): one row per file, whole text.

    Files named as plain text come as bytes: a file costs Spark's text reader some 3 ms, whatever it holds. That reader takes the
    other names, because it unpacks what a codec has packed. Tasks list and read a folder without folders in it where it is
    mounted: its listing is a stage table.
    """
    name = F.col("_metadata.file_name")

    def rows(files: DataFrame, file: Column, value: Column) -> DataFrame:
        return files.select(file.alias("source_file"), decoded(value).alias("text"))

    folder = folder_on_disk(spark, path)
    listed = staged(files_on_disk(spark, folder), "listing") if folder else None
    if listed is not None and listed.where("folder").isEmpty():
        plain = F.col("label").rlike(PLAIN_NAME)
        kinds = listed.agg(
            F.bool_and(plain).alias("all"), F.bool_or(plain).alias("some"), F.count_if(plain).alias("found"), F.sum(F.when(plain, F.col("size"))).alias("size"),
        ).first()
        files = contents_on_disk(folder, listed.where(plain), kinds["found"], kinds["size"] or 0)
        file, value = F.col("label"), F.col("content").cast("string")
    else:
        plain = name.rlike(PLAIN_NAME)
        files = spark.read.format("binaryFile").load(path)
        kinds = files.select(plain.alias("plain")).coalesce(LISTING_TASKS).agg(F.bool_and("plain").alias("all"), F.bool_or("plain").alias("some")).first()
        files = files if kinds["all"] is not False else files.where(plain)
        file, value = name, F.col("content").cast("string")
    parts = []
    if kinds["some"] is not False:
        parts.append(rows(files, file, value))
    if kinds["all"] is False:
        parts.append(rows(spark.read.text(path, wholetext=True).where(~name.rlike(PLAIN_NAME)), name, F.col("value")))
    return reduce(DataFrame.unionByName, parts)


def read_markdown(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, text): one row per file, Markdown marks removed."""
    return read_text(spark, path).withColumn("text", strip_markdown(F.col("text")))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nulls_for_nans(spark.read.parquet(path))


def write_stage(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Write each result as ``folder/<name>.parquet``; returns the paths."""
    paths = []
    for name, df in tables.items():
        path = f"{folder}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths


def snapshot(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first rows in row order (a bounded top-n per task, no full sort)."""
    return df.orderBy(*order_by).limit(n)
