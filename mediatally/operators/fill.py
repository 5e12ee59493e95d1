"""Forward then backward fill in row order, without pulling the table through one task.

The row order is the caller's list of order columns; rows that agree in all of them come in the order of a hash of the
row, so a hot key is cut too. The table is laid out in ranges of that order:

1. the input is evaluated once, into a stage table (unless it is one), which is dealt to ranges of even size and sorted there; Spark takes the
   bounds from a bounded sample of the order columns and the hash, so a hot leading column, such as one day with a third of
   all rows, is cut by those behind it;
2. each range is filled forward as it streams past;
3. one row per range, its last value, carries values over range borders;
4. what is still empty lies before the first value of the whole table and takes that value.

The bounds only balance the work; the result does not depend on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatally.session import staged

RANGES = None  # as many as the session has shuffle partitions


def _filled_forward(laid: DataFrame, columns: list[str]) -> DataFrame:
    """The sorted ranges with __near_<c> (the last value so far), __range and __nth (place in the range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, done = TaskContext.get().partitionId(), 0
        last: dict = {}
        for batch in batches:
            near = []
            for c in columns:
                values = pc.fill_null_forward(batch.column(c))
                near.append(values.fill_null(last[c]) if c in last and values.null_count else values)
                if len(values) and near[-1][-1].is_valid:
                    last[c] = near[-1][-1]
            place = [pa.array([number] * batch.num_rows, pa.int32()), pa.array(range(done, done + batch.num_rows), pa.int64())]
            done += batch.num_rows
            names = [*batch.schema.names, *(f"__near_{c}" for c in columns), "__range", "__nth"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *near, *place], names)

    more = [*(T.StructField(f"__near_{c}", laid.schema[c].dataType) for c in columns), T.StructField("__range", T.IntegerType()), T.StructField("__nth", T.LongType())]
    return laid.mapInArrow(run, T.StructType([*laid.schema.fields, *more]))


def fill_times(df: DataFrame, columns: list[str], order_by: list[str], ranges: int | None = RANGES, stored: bool = False) -> DataFrame:
    """Each null takes the last value before it in the order, else the first value of all.

    ``ranges`` should be a few times the number of cores for large tables. ``stored`` says that the input is a stage table.
    """
    order = df.columns
    source = (df if stored else staged(df, "fill-input")).withColumn("__tie", F.xxhash64(*order))
    keys = [*order_by, "__tie"]
    cut = source.repartitionByRange(ranges, *keys) if ranges else source.repartitionByRange(*keys)
    # What is filled forward says all that its column did.
    laid = staged(_filled_forward(cut.sortWithinPartitions(*keys), columns).drop("__tie", *columns), "fill-ranges")
    edges = laid.groupBy("__range").agg(
        *[F.max_by(f"__near_{c}", "__nth").alias(f"__last_{c}") for c in columns],
        *[F.min_by(f"__near_{c}", F.when(F.col(f"__near_{c}").isNotNull(), F.col("__nth"))).alias(f"__first_{c}") for c in columns],
    )
    # One row for each range, so one task is the right size for the carry.
    by_range = Window.orderBy("__range")
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = edges.select(
        "__range",
        *[F.last(f"__last_{c}", True).over(earlier).alias(f"__carried_{c}") for c in columns],
        *[F.first(f"__first_{c}", True).over(whole).alias(f"__lead_{c}") for c in columns],
    )
    filled = {c: F.coalesce(f"__near_{c}", f"__carried_{c}", f"__lead_{c}") for c in columns}
    return laid.join(F.broadcast(carry), "__range", "left").withColumns(filled).select(*order)
