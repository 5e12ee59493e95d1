"""Folders of a mounted file system, listed and read by tasks, so that the driver holds none of their files.

Spark's file sources list a folder in the driver, keep an object for each file there and plan a task for every few files, however
small. Other stores are left to them. Both take the same files: names that begin with a dot or an underscore are hidden, empty
files hold no row.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Names that a task hands on at a time, bytes of contents it does, files and bytes that one task reads, tasks that look through entries.
NAMES, CHUNK_BYTES = 4096, 4 << 20
FILES_OF_A_TASK, BYTES_OF_A_TASK = 500, 32 << 20
LISTING_TASKS = 64
# What Java quotes in the path of a URI, control characters and blanks of any kind aside.
QUOTED = frozenset('"#%<>?[\\]^`{|}')


def folder_on_disk(spark: SparkSession, path: str | list[str]) -> str | None:
    """The folder that a path names on a mounted file system; none for other stores, files, lists and paths with wildcards."""
    if not isinstance(path, str) or not re.match(r"(file:(//)?)?/(?!/)", path):
        return None
    if path.startswith("/") and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:"):
        return None
    place = path.removeprefix("file:").removeprefix("//")
    if re.search(r"[\[\]{}*?\\]", re.sub(r"(?s)\\.", "", place)):
        return None
    folder = re.sub(r"(?s)\\(.)", r"\1", place).rstrip("/")
    return folder if os.path.isdir(folder) else None


def _looks() -> tuple[Callable, Callable]:
    """Functions that tasks take along: what of a folder is not hidden, and the bytes of a file."""
    def seen(folder: str) -> Iterator[os.DirEntry]:
        with os.scandir(folder) as found:
            for e in found:
                if not (e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name or e.name.endswith("._COPYING_")):
                    yield e

    def size(e: os.DirEntry) -> int:
        try:
            return e.stat().st_size
        except FileNotFoundError:  # a link to nothing, or gone since
            return 0

    return seen, size


def entries_on_disk(spark: SparkSession, folder: str, kinds: list[str]) -> DataFrame:
    """(name, folder, nested) of the entries of a folder whose names end in a known suffix and that hold a file, empty ones aside.

    One task reads the names of the entries, and they are dealt to tasks that look into them.
    """
    seen, size = _looks()
    suffixes = tuple(f".{kind}" for kind in kinds)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with os.scandir(folder) as found:  # a folder that is named is no hidden one
                known = [e.name for e in found if e.name.endswith(suffixes) and e.name not in suffixes]
            yield pa.RecordBatch.from_pydict({"name": pa.array(known, pa.string())})

    def filled(place: str) -> bool:
        below = []
        for e in seen(place):
            if e.is_dir():
                below.append(e.path)
            elif size(e):
                return True
        return any(map(filled, below))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                place = f"{folder}/{name}"
                if not os.path.isdir(place):
                    if name[0] not in "._" or name[0] == "_" and "=" in name:
                        rows += [{"name": name, "folder": False, "nested": False}] * (os.path.exists(place) and os.path.getsize(place) > 0)
                    continue
                direct, below = False, []
                for e in seen(place):
                    if e.is_dir():
                        below.append(e)
                    else:
                        direct = direct or size(e) > 0
                nested = any("=" not in e.name and filled(e.path) for e in below)
                if direct or nested or any(filled(e.path) for e in below):
                    rows.append({"name": name, "folder": True, "nested": nested})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("name", pa.string()), ("folder", pa.bool_()), ("nested", pa.bool_())]))

    tasks = min(LISTING_TASKS, spark.sparkContext.defaultParallelism)
    dealt = spark.range(0, 1, 1, 1).mapInArrow(names, "name string").repartition(tasks, "name")
    return dealt.mapInArrow(look, "name string, folder boolean, nested boolean")


def files_on_disk(spark: SparkSession, folder: str) -> DataFrame:
    """(name, label, size, folder) of what lies in a folder, hidden and empty files aside; ``label`` is the name as Spark quotes it.

    One task reads the names, a few thousand at a time.
    """
    seen, size = _looks()
    kinds = pa.schema([("name", pa.string()), ("label", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])

    def quoted(name: str) -> str:
        odd = lambda c: c in QUOTED or unicodedata.category(c) in ("Cc", "Zs", "Zl", "Zp")
        return "".join("".join(f"%{b:02X}" for b in c.encode()) if odd(c) else c for c in name)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        for _ in batches:
            rows: list[tuple] = []
            for e in seen(folder):
                inner = e.is_dir()
                length = 0 if inner else size(e)
                if inner or length:
                    rows.append((e.name, e.name if re.fullmatch(r"[\w.-]+", e.name) else quoted(e.name), length, inner))
                if len(rows) == NAMES:
                    yield chunk(rows)
                    rows = []
            if rows:
                yield chunk(rows)

    return spark.range(0, 1, 1, 1).mapInArrow(names, "name string, label string, size long, folder boolean")


def contents_on_disk(folder: str, files: DataFrame, found: int, size: int) -> DataFrame:
    """(label, content): the bytes of files of a folder, of which there are ``found`` with ``size`` bytes in all.

    Files are dealt by their names to tasks of a bounded number of files and bytes; a task holds a few megabytes or one file at a time.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(labels: list[str], contents: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(contents, pa.binary())], ["label", "content"])

        for batch in batches:
            labels, contents, held = [], [], 0
            for name, label in zip(*(c.to_pylist() for c in batch.columns)):
                with open(f"{folder}/{name}", "rb") as file:
                    contents.append(file.read())
                labels.append(label)
                held += len(contents[-1])
                if held >= CHUNK_BYTES:
                    yield chunk(labels, contents)
                    labels, contents, held = [], [], 0
            if labels:
                yield chunk(labels, contents)

    few = min(files.sparkSession.sparkContext.defaultParallelism, -(-found // 32))
    tasks = max(1, few, -(-found // FILES_OF_A_TASK), -(-size // BYTES_OF_A_TASK))
    return files.select("name", "label").repartition(tasks, "name").mapInArrow(read, "label string not null, content binary")
