"""Text documents to one metric row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatally.functions.patterns import ENTITIES, NUMERIC_METRICS, entity_struct, metric_struct, raw_lists

LISTED = 5


def _with_lists(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """The matches of every list as columns of their own, so that each pattern runs once a row."""
    lists = raw_lists(F.col(text))
    return df.withColumns({f"__{n}": c for n, c in lists.items()}), {n: F.col(f"__{n}") for n in lists}


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``metrics`` and ``entities`` structs found in the text column."""
    listed, raw = _with_lists(df, text)
    return listed.withColumns({"metrics": metric_struct(raw), "entities": entity_struct(raw)}).select(*df.columns, "metrics", "entities")


def document_rows(df: DataFrame, file: str = "source_file", text: str = "text") -> DataFrame:
    """One row per document: totals and counts of number lists, counts and first five of entity lists.

    Lists kept as text (percentages, dollar amounts, ctr, dates) give no metric column. Without a match a
    total, count or list is null; entity counts are 0.
    """
    listed, raw = _with_lists(df, text)
    metrics, entities = metric_struct(raw), entity_struct(raw)
    made = listed.select(
        F.col(file).alias("source_file"), *[metrics[m].alias(f"__{m}") for m in NUMERIC_METRICS], *[entities[e].alias(f"__e_{e}") for e in ENTITIES],
    )
    fields: list[Column] = [F.col("source_file"), F.lit("regex").alias("extraction_method")]
    for metric in NUMERIC_METRICS:
        values = F.col(f"__{metric}")
        fields.append(F.aggregate(values, F.lit(0.0), lambda a, b: a + b).alias(f"{metric}_total"))
        fields.append(F.when(values.isNotNull(), F.size(values)).cast("bigint").alias(f"{metric}_count"))
    for entity in ENTITIES:
        names = F.col(f"__e_{entity}")
        fields.append(F.size(names).cast("bigint").alias(f"{entity}_count"))
        if entity not in ("products", "companies"):
            fields.append(
                F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, LISTED), ", ")).alias(f"{entity}_list")
            )
    return made.select(*fields)


def document_summary(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents read and failed, characters read. A null text is a document that failed."""
    value = F.col(text)
    return df.agg(
        F.count_if(value.isNotNull()).alias("files_processed"),
        F.count_if(value.isNull()).alias("files_failed"),
        F.coalesce(F.sum(F.length(value)), F.lit(0)).alias("total_chars_extracted"),
    )


def method_counts(rows: DataFrame) -> DataFrame:
    """(extraction_method, files)."""
    return rows.groupBy("extraction_method").agg(F.count(F.lit(1)).alias("files"))


def failed_documents(df: DataFrame, file: str = "source_file", text: str = "text") -> DataFrame:
    """(file, error) of documents without readable text."""
    return df.where(F.col(text).isNull()).select(F.col(file).alias("file"), F.lit("unreadable text").alias("error"))
