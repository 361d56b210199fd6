"""Global row numbers, batch numbers and running totals without a one-task window.

Rows are range-partitioned by their order, numbered inside each partition, and shifted by the
size of the earlier partitions. The partitioned rows are written once, because both steps must
see the same partitions; the shifts are one row per partition, which is what gets broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.scratch import write_scratch

# Most rows and most payload bytes of one batch.
ROW_LIMIT = 5_000
BYTE_BUDGET = 16 * 1024 * 1024


def _ranged(
    df: DataFrame, order: Sequence[Column], partitions: int | None, unique: bool = False
) -> DataFrame:
    """Rows in ranges of the total order; without an order they stay where the scan left them.

    Unless the order is unique, a hash of the row breaks ties, so rows that share a hot order
    value still spread over several ranges, in an order that a retry repeats.
    """
    if not order:
        return df
    total = list(order) if unique else [*order, F.xxhash64(*df.columns).asc()]
    if partitions is None:
        ranged = df.repartitionByRange(*total)
    else:
        ranged = df.repartitionByRange(partitions, *total)
    return ranged.sortWithinPartitions(*total)


def _shifts(sizes: DataFrame, size: str) -> DataFrame:
    """Sum of the earlier partitions' sizes; one row per partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias("_shift"))


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "rn",
    partitions: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add `name`, the 1-based ROW_NUMBER over `order`, to every row.

    With an empty order the rows are numbered as scanned, without a shuffle. Say `unique` when
    no two rows share an order value.
    """
    low_bits = (1 << 33) - 1
    position = F.monotonically_increasing_id()
    kept = write_scratch(
        _ranged(df, order, partitions, unique).select(
            "*",
            F.shiftright(position, 33).alias("_part"),
            position.bitwiseAND(F.lit(low_bits)).alias("_index"),
        ),
        "numbered",
    )
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_size"))
    return (
        kept.join(F.broadcast(_shifts(sizes, "_size")), "_part")
        .withColumn(name, F.col("_shift") + F.col("_index") + 1)
        .drop("_part", "_index", "_shift")
    )


def page(df: DataFrame, order: Sequence[Column], first: int, last: int) -> DataFrame:
    """Rows whose number over `order` lies between `first` and `last`."""
    return number_rows(df, order).filter(F.col("rn").between(first, last))


def number_batches(
    df: DataFrame, order: Sequence[Column], row_limit: int = ROW_LIMIT, unique: bool = False
) -> DataFrame:
    """Add ``batch_no`` and ``row_no`` for batches cut by row count only."""
    zero_based = F.col("rn") - 1
    return (
        number_rows(df, order, unique=unique)
        .withColumn("batch_no", F.floor(zero_based / row_limit).cast("bigint") + 1)
        .withColumn("row_no", (zero_based % row_limit) + 1)
        .drop("rn")
    )


def canonical_cells(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The cells of a row as canonical texts, the form in which values travel."""
    from tableferry.functions import canon

    cells = []
    for name in columns or df.columns:
        kind, value = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.DecimalType):
            cells.append(canon.number_text(value))
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            cells.append(canon.timestamp_text(value))
        else:
            cells.append(value.cast("string"))
    return F.array(*cells)


def _cut_batches(row_limit: int, byte_budget: int):
    """Greedy cut of one partition's ordered rows, on the `_bytes` column only.

    A payload is ``{"seq":N,"rows":[r1,r2,...]}``: its fixed part, its rows, and the commas
    between them. A batch ends when one more row would pass a limit; a single row over the
    budget travels alone. Only the first partition knows its final batch numbers, so the
    others reserve room for the longest number.
    """
    frame = len('{"seq":,"rows":[]}')

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_no, rows, used = 1, 0, 0
        for block in batches:
            sizes = block.column("_bytes").to_numpy()
            first = block.num_rows > 0 and block.column("_part")[0].as_py() == 0
            ends = np.cumsum(sizes)
            numbers = np.empty(len(sizes), dtype=np.int64)
            places = np.empty(len(sizes), dtype=np.int64)
            start = 0
            while start < len(sizes):
                fixed = frame + (len(str(batch_no)) if first else 19)
                # Payload with k more rows of this block: commas grow with the row count.
                before = ends[start] - sizes[start]
                ahead = ends[start : start + row_limit - rows] - before
                payload = fixed + used + ahead + rows + np.arange(len(ahead))
                take = int(np.searchsorted(payload, byte_budget, side="right"))
                if take == 0 and rows == 0:
                    take = 1
                if take > 0:
                    stop = start + take
                    numbers[start:stop] = batch_no
                    places[start:stop] = np.arange(rows + 1, rows + take + 1)
                    used += int(ends[stop - 1] - before)
                    rows += take
                    start = stop
                if start < len(sizes):
                    batch_no, rows, used = batch_no + 1, 0, 0
            columns = [*block.columns, pa.array(numbers), pa.array(places)]
            names = [*block.schema.names, "_local", "row_no"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def assign_batches(
    df: DataFrame,
    order: Sequence[Column],
    cells: Column | None = None,
    row_limit: int = ROW_LIMIT,
    byte_budget: int = BYTE_BUDGET,
    partitions: int | None = None,
    unique: bool = False,
    path: str | None = None,
    seen: Observation | None = None,
    cut: Observation | None = None,
) -> DataFrame:
    """Add ``batch_no, row_no, row_bytes``: batches within both limits, numbered from 1 with no gap.

    A batch never spans two ranges, so with one partition the cut is the plain greedy one over
    the whole order, and with many it only adds at most one short batch per range. A task
    without ORDER BY passes no order, and its rows are cut in scan order without any shuffle.

    The cut rows are written to `path` (a scratch folder by default); `seen` observes the number
    of ``rows`` on their way into the cut, `cut` that of ``rows`` and ``batches`` that come out of it.
    """
    cells = canonical_cells(df) if cells is None else cells
    # Sizes are taken after the rows are in place, so the range sampling does not compute them.
    sized = _ranged(df, order, partitions, unique).select(
        "*",
        F.octet_length(F.to_json(cells)).cast("bigint").alias("_bytes"),
        F.spark_partition_id().cast("bigint").alias("_part"),
    )
    if seen is not None:
        sized = sized.observe(seen, F.count(F.lit(1)).alias("rows"))
    schema = T.StructType(
        [*sized.schema.fields, T.StructField("_local", T.LongType()), T.StructField("row_no", T.LongType())]
    )
    batched = sized.mapInArrow(_cut_batches(row_limit, byte_budget), schema)
    if cut is not None:
        batched = batched.observe(cut, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("row_no") == 1).alias("batches"))
    kept = write_scratch(batched, "batched", path)
    sizes = kept.groupBy("_part").agg(F.max("_local").alias("_size"))
    return (
        kept.join(F.broadcast(_shifts(sizes, "_size")), "_part")
        .withColumn("batch_no", F.col("_shift") + F.col("_local"))
        .withColumnRenamed("_bytes", "row_bytes")
        .drop("_part", "_local", "_shift")
    )


def running_total(
    df: DataFrame, group: Sequence[str], order: str, value: str, name: str, chunk: int = 10_000
) -> DataFrame:
    """Running sum of `value` per group in the order of the whole number `order`.

    Works in chunks of the order column: chunk totals are summed map-side, shifted, and joined
    back, so no task holds more than one chunk even when one group owns most rows.
    """
    group = list(group)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("bigint"))
    totals = chunked.groupBy(*group, "_chunk").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*group, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn(name, F.sum(value).over(inside))
        .join(shifts, [*group, "_chunk"])
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop("_chunk", "_shift")
    )


def sequence_gaps(batches: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Where a run's batch numbers jump: ``run_id, expected, got``, starting from 1.

    Only the first and last number of each chunk travel to the run-wide comparison.
    """
    numbers = batches.select("run_id", "batch_no").distinct()
    chunked = numbers.withColumn("_chunk", F.floor(F.col("batch_no") / chunk).cast("bigint"))
    inside = Window.partitionBy("run_id", "_chunk").orderBy("batch_no")
    in_chunk = chunked.withColumn("_previous", F.lag("batch_no").over(inside))
    edges = chunked.groupBy("run_id", "_chunk").agg(
        F.min("batch_no").alias("got"), F.max("batch_no").alias("_last")
    )
    across = Window.partitionBy("run_id").orderBy("_chunk")
    starts = edges.select(
        "run_id", (F.coalesce(F.lag("_last").over(across), F.lit(0)) + 1).alias("expected"), "got"
    )
    inner = in_chunk.filter(F.col("_previous").isNotNull()).select(
        "run_id", (F.col("_previous") + 1).alias("expected"), F.col("batch_no").alias("got")
    )
    return starts.unionByName(inner).filter("got != expected")
