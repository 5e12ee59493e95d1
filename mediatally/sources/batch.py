"""A batch folder: every CSV, JSON, text and Markdown entry, merged into one table.

An entry is a file, or a folder of files at any depth, whose name ends in a known suffix. JSON
part files hold one value per line, a single JSON file is one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatally.operators.documents import document_rows
from mediatally.operators.merge import merge_sources, merge_tables
from mediatally.operators.names import name_mapping, normalise_names
from mediatally.sources.files import literal_path, read_csv, read_json, read_markdown, read_text
from mediatally.sources.listing import LISTING_TASKS, entries_on_disk, folder_on_disk

# Known suffixes in reading order. PDF text needs a codec this package does not carry.
STRUCTURED = ["csv", "json"]
UNSTRUCTURED = ["txt", "md", "markdown"]


class Entry(NamedTuple):
    name: str
    kind: str
    category: str
    path: str
    folder: bool
    nested: bool  # files lie deeper, in folders that are no partitions


class Batch(NamedTuple):
    table: DataFrame
    structured: DataFrame | None
    documents: DataFrame | None
    entries: list[Entry]
    tables: dict[str, DataFrame]
    mapping: list[tuple[str, str]]
    texts: DataFrame | None  # the documents as read


def list_entries(spark: SparkSession, folder: str) -> list[Entry]:
    """Known entries of a folder, by type in reading order, then by name. Tasks look through a folder that is mounted."""
    root = folder.rstrip("/")
    kinds = [*STRUCTURED, *UNSTRUCTURED]
    disk = folder_on_disk(spark, literal_path(root))
    found = entries_on_disk(spark, disk, kinds).orderBy("name").toLocalIterator() if disk else _listed(spark, root, kinds)
    entries = []
    for row in found:
        kind = row.name.rsplit(".", 1)[1]
        category = "structured" if kind in STRUCTURED else "unstructured"
        entries.append(Entry(row.name, kind, category, literal_path(f"{root}/{row.name}"), row.folder, row.nested))
    return sorted(entries, key=lambda e: kinds.index(e.kind))


def _listed(spark: SparkSession, root: str, kinds: list[str]) -> Iterator[Row]:
    """(name, folder, nested) of the entries by the listings that Spark makes in the driver."""
    above = re.escape(root.rsplit("/", 1)[-1])
    for kind in kinds:
        try:
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{literal_path(root)}/*.{kind}").select("path").coalesce(LISTING_TASKS)
        except AnalysisException:
            continue  # nothing of this type
        shape = rf"/{above}/([^/]+\.{kind})(/.+)?$"
        below = F.regexp_extract("path", shape, 2)
        found = listed.select(F.regexp_extract("path", shape, 1).alias("name"), below.alias("below")).groupBy("name").agg(
            F.bool_or(F.col("below") != "").alias("folder"), F.bool_or(F.col("below").rlike("^/[^/=]+/")).alias("nested"),
        )
        yield from found.where("name <> ''").orderBy("name").toLocalIterator()


def read_entry(spark: SparkSession, entry: Entry, schema: T.StructType | str | None = None, **csv) -> DataFrame:
    """The entry as a table; ``csv`` goes to read_csv."""
    if entry.kind == "csv":
        return read_csv(spark, entry.path, schema, recursive=entry.nested, **csv)
    if entry.kind == "json":
        return read_json(spark, entry.path, schema, lines=entry.folder)
    if entry.kind == "txt":
        return read_text(spark, entry.path)
    return read_markdown(spark, entry.path)


def read_batch(spark: SparkSession, folder: str, schemas: dict[str, T.StructType | str] | None = None, **csv) -> Batch:
    """Read a folder: tables merged on shared keys, documents to metric rows, both united.

    ``schemas`` by entry name spare the checking pass; ``csv`` goes to read_csv.
    """
    entries = list_entries(spark, folder)
    if not entries:
        raise ValueError(f"no known files in {folder}")
    tables = {e.name: read_entry(spark, e, (schemas or {}).get(e.name), **csv) for e in entries}
    tabular = [tables[e.name] for e in entries if e.category == "structured"]
    texts = [tables[e.name] for e in entries if e.category == "unstructured"]
    structured = merge_tables(tabular) if tabular else None
    mapping = list(dict.fromkeys(pair for t in tabular for pair in name_mapping(t)))
    all_texts = reduce(DataFrame.unionByName, texts) if texts else None
    documents = document_rows(all_texts) if texts else None
    table = normalise_names(merge_sources(structured, documents))
    return Batch(table, structured, documents, entries, tables, mapping, all_texts)


def ingest_statistics(spark: SparkSession, batch: Batch) -> DataFrame:
    """(filename, type, category, rows, columns) per entry; documents count one row per file."""
    parts = []
    for entry in batch.entries:
        df = batch.tables[entry.name]
        width = len(df.columns) if entry.category == "structured" else len(batch.documents.columns)
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(entry.name).alias("filename"), F.lit(entry.kind).alias("type"),
            F.lit(entry.category).alias("category"), "rows", F.lit(width).alias("columns"),
        ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def ingest_totals(batch: Batch) -> DataFrame:
    """One row: entries read, rows and columns of the merged table, and columns of its tables and document rows."""
    parts = [t for t in (batch.structured, batch.documents) if t is not None]
    return batch.table.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(len(batch.entries)).cast("bigint").alias("files"), "rows", F.lit(len(batch.table.columns)).alias("columns"),
        F.lit(sum(len(p.columns) for p in parts)).alias("source_columns"),
    )


def mapping_frame(spark: SparkSession, mapping: list[tuple[str, str]]) -> DataFrame:
    """(old_name, new_name); built from the schema, as small as the header."""
    return spark.createDataFrame(mapping, "old_name string, new_name string")
