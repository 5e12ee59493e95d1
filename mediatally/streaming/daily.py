"""Structured Streaming forms of the cleaning projection and the daily KPIs.

Imputation, z-scores and medians need the whole table and stay batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mediatally.functions.numbers import ratio_or_zero, total
from mediatally.operators.aggregate import OVERALL_RATIOS
from mediatally.operators.derive import derive_metrics
from mediatally.operators.names import normalise_names
from mediatally.operators.parse import parse_time_columns
from mediatally.sources.files import csv_records


def clean_rows(df: DataFrame) -> DataFrame:
    """The row-local part of cleaning: names, time columns, numbers, ratios."""
    return derive_metrics(parse_time_columns(normalise_names(df)))


def arriving_csv(
    spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int | None = None, multiline: bool = False,
) -> DataFrame:
    """Cleaned rows of CSV files as they arrive in a folder, read as the batch reader reads them with a schema.

    Files are split over tasks; ``multiline``, for quoted line breaks, reads each file whole.
    """
    reader = spark.readStream.option("multiLine", multiline)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return clean_rows(csv_records(reader, folder, schema))


def append_rows(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append arriving rows to Parquet, once each, until the input present is used up."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def daily_kpis(df: DataFrame, time: str, metrics: list[str], delay: str = "1 day") -> DataFrame:
    """(date, <metric>_sum ..., overall ratios of the day): day windows; rows later than ``delay`` are dropped.

    Days are those of the column's own clock: a time without zone is taken as it is written, a time with zone as the
    session shows it. State is one row of sums per open day.
    """
    sums = [total(F.col(m)).alias(f"{m}_sum") for m in metrics]
    # Windows need instants and are cut in UTC, so the clock is put there, whatever zone the session is in.
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', __clock)")
    clock = df.withColumn("__clock", F.col(time).cast("timestamp_ntz")).withColumn("__at", F.timestamp_micros(micros))
    days = clock.withWatermark("__at", delay).groupBy(F.window(F.col("__at"), "1 day")).agg(*sums)
    ratios = [
        ratio_or_zero(F.col(f"{num}_sum"), F.col(f"{den}_sum"), factor, 4).alias(name)
        for name, num, den, factor in OVERALL_RATIOS
        if num in metrics and den in metrics
    ]
    day = F.date_from_unix_date((F.unix_seconds("window.start") / 86400).cast("int"))
    return days.select(day.alias("date"), *[f"{m}_sum" for m in metrics], *ratios)


def update_days(days: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the days that changed in each batch, once each, until the input present is used up.

    A batch that is repeated after a failure replaces its own folder, so latest_days() sees each batch once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        days.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_days(spark: SparkSession, target: str) -> DataFrame:
    """Every day as its last batch left it, the days still open included."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    columns = [c for c in rows.columns if c not in ("date", "batch")]
    last = rows.groupBy("date").agg(F.max_by(F.struct(*columns), "batch").alias("last"))
    return last.select("date", "last.*")
