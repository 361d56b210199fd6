"""The exact greedy batch cut over any number of partitions.

A batch ends before the row that would pass a limit, so its successor starts at a row that depends on
its own first row only: each row has a successor pointer, found by search in prefix sums of the rows'
bytes. Rows are looked at in blocks of as many rows as a batch may hold, so a pointer ends in its
own block or the next one. Pointer doubling inside a block gives a map: from the row at which a
batch chain enters the block to the row at which it enters the next, and the number of batches
between. Maps of neighbouring blocks are composed up a tree, and the one chain that starts at the
first row is followed down it, so the cut doesn't depend on how the rows are partitioned.

The number of a batch is part of its bytes. Pointers therefore hold for numbers of equal length; the
chain is followed length by length, and the batches of short numbers, which lie in the first blocks,
are cut one after the other.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.operators.numbering import BYTE_BUDGET, ROW_LIMIT, canonical_cells, number_rows
from tableferry.scratch import write_scratch

#: Blocks whose maps one task composes; digits of the batch numbers that are cut one after the other.
ARITY, SHORT_DIGITS = 256, 3
FRAME = len('{"seq":,"rows":[]}')

# What runs on executors is sent by value: they need numpy and pyarrow but not this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STARTS_SCHEMA = "block bigint, before bigint, starts array<int>, exit bigint"


def successors(sizes: np.ndarray, ahead: np.ndarray, frame: int, row_limit: int, byte_budget: int) -> np.ndarray:
    """For each row of a block the row after the batch that starts there, counted from the block's first row.

    Bytes are the frame, the rows and the commas between them; a single row over the budget is a batch.
    """
    whole = np.concatenate((sizes, ahead))
    sums = np.concatenate(([0], np.cumsum(whole + 1)))
    rows = np.arange(len(sizes))
    fits = np.searchsorted(sums, sums[rows] + byte_budget - frame + 1, "right") - 1
    return np.minimum(np.maximum(fits, rows + 1), np.minimum(rows + row_limit, len(whole)))


def block_map(following: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry into the next block, batches started) for every entry into a block, its end included."""
    to, count = np.append(following, rows), np.append(np.ones(rows, np.int64), 0)
    while (inside := np.flatnonzero(to < rows)).size:
        at = to[inside]
        count[inside], to[inside] = count[inside] + count[at], to[at]
    return to - rows, count


def _arrays(table: pa.Table, name: str) -> list[np.ndarray]:
    return [np.array(x or [], np.int64) for x in table.column(name).to_pylist()]


def _binary(arrays) -> pa.Array:
    return pa.array([np.asarray(a, np.int64).tobytes() for a in arrays], pa.binary())


def _numbers(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def _blocks(numbered: DataFrame, row_limit: int) -> DataFrame:
    """Written blocks: the sizes of their rows and those of the next block."""
    rows = numbered.select(F.expr(f"(rn - 1) div {row_limit}").alias("block"), "rn", "row_bytes")
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("rn", "row_bytes"))), lambda r: r["row_bytes"])
    own = write_scratch(rows.groupBy("block").agg(sizes.alias("sizes")), "blocks")
    following = own.select((F.col("block") - 1).alias("block"), F.col("sizes").alias("ahead"))
    return write_scratch(own.join(following, "block", "left"), "blocks")


def _short_numbers(blocks: DataFrame, row_limit: int, byte_budget: int) -> DataFrame:
    """Starts of the batches of short numbers, in the first blocks: at most one block a batch."""
    most = 10**SHORT_DIGITS - 1

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        out, number, entry = [], 1, 0
        for block, sizes, ahead in zip(table.column("block").to_pylist(), _arrays(table, "sizes"), _arrays(table, "ahead")):
            following = {}
            before, starts, at = number - 1, [], entry
            while at < len(sizes) and number <= most:
                digits = len(str(number))
                if digits not in following:
                    following[digits] = successors(sizes, ahead, FRAME + digits, row_limit, byte_budget)
                starts.append(at)
                at, number = int(following[digits][at]), number + 1
            out.append((block, before, starts, at - len(sizes) if at >= len(sizes) else -1 - at))
            if number > most and at < len(sizes):
                break
            entry = at - len(sizes)
        return pa.table(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()))],
            names=["block", "before", "starts", "exit"],
        )

    first = blocks.filter(F.col("block") < most)
    return write_scratch(first.groupBy(F.lit(0).alias("all")).applyInArrow(cut, STARTS_SCHEMA), "starts")


def _maps(blocks: DataFrame, first: int, frame: int, row_limit: int, byte_budget: int) -> DataFrame:
    """(node, entries, counts) of the blocks from `first` on."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            found = []
            for sizes, ahead in zip(_arrays(table, "sizes"), _arrays(table, "ahead")):
                found.append(block_map(successors(sizes, ahead, frame, row_limit, byte_budget), len(sizes)))
            node = pa.array([b - first for b in batch.column("block").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([node, _binary(f[0] for f in found), _binary(f[1] for f in found)], ["node", "entries", "counts"])

    return blocks.mapInArrow(run, "node bigint, entries binary, counts binary")


def _composed(table: pa.Table) -> pa.Table:
    """One map of neighbouring maps."""
    table = table.sort_by("node")
    maps = list(zip(_numbers(table.column("entries")), _numbers(table.column("counts"))))
    at, count = np.arange(len(maps[0][0])), np.zeros(len(maps[0][0]), np.int64)
    for entries, counts in maps:
        count, at = count + counts[at], entries[at]
    node = table.column("node")[0].as_py() // ARITY
    return pa.table([pa.array([node], pa.int64()), _binary([at]), _binary([count])], names=["node", "entries", "counts"])


def _entered(parents: pa.Table, children: pa.Table) -> pa.Table:
    """Where the chain enters each child of a node, and how many batches started before."""
    children = children.sort_by("node")
    out = []
    if parents.num_rows:
        at, count = parents.column("entry")[0].as_py(), parents.column("before")[0].as_py()
        for node, entries, counts in zip(children.column("node").to_pylist(), _numbers(children.column("entries")), _numbers(children.column("counts"))):
            out.append((node, at, count))
            count, at = count + int(counts[at]), int(entries[at])
    return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["node", "entry", "before"])


def _followed(blocks: DataFrame, first: int, entry: int, digits: int, row_limit: int, byte_budget: int) -> DataFrame:
    """Starts of the batches whose numbers have this many digits, from row `entry` of block `first` on."""
    spark, frame = blocks.sparkSession, FRAME + digits
    lowest, batches = 10 ** (digits - 1), 9 * 10 ** (digits - 1)
    here = blocks.filter(F.col("block").between(first, first + batches))
    levels = [write_scratch(_maps(here, first, frame, row_limit, byte_budget), "maps")]
    while levels[-1].agg(F.max("node")).first()[0]:
        up = levels[-1].groupBy(F.expr(f"node div {ARITY}").alias("up")).applyInArrow(_composed, "node bigint, entries binary, counts binary")
        levels.append(write_scratch(up, "maps"))
    entered = spark.range(1).select(F.col("id").alias("node"), F.lit(entry).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("before"))
    for level in reversed(levels[:-1]):
        parents = entered.groupBy("node")
        entered = parents.cogroup(level.groupBy(F.expr(f"node div {ARITY}").alias("up"))).applyInArrow(_entered, "node bigint, entry bigint, before bigint")
    entered = entered.filter(F.col("before") < batches).select((F.col("node") + first).alias("block"), "entry", "before")

    def starts(batches_):
        for batch in batches_:
            table, out = pa.Table.from_batches([batch]), []
            for at, before, sizes, ahead in zip(
                batch.column("entry").to_pylist(), batch.column("before").to_pylist(), _arrays(table, "sizes"), _arrays(table, "ahead")
            ):
                following, found = successors(sizes, ahead, frame, row_limit, byte_budget), []
                while at < len(sizes) and before + len(found) < batches:
                    found.append(at)
                    at = int(following[at])
                # Where the chain goes on: in the next block, or (below zero) in this one with a longer number.
                out.append((found, at - len(sizes) if at >= len(sizes) else -1 - at))
            number = pa.array([lowest - 1 + b for b in batch.column("before").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), number, pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.int64())],
                ["block", "before", "starts", "exit"],
            )

    return write_scratch(here.join(entered, "block").mapInArrow(starts, STARTS_SCHEMA), "starts")


def batch_starts(blocks: DataFrame, row_limit: int, byte_budget: int) -> DataFrame:
    """(block, before, starts): the batches that start in each block, and the number of those before it."""
    last = blocks.agg(F.max("block")).first()[0]
    found = _short_numbers(blocks, row_limit, byte_budget)
    parts, digits = [found], SHORT_DIGITS
    while True:
        end = parts[-1].agg(F.max_by(F.struct("block", "before", F.size("starts").alias("n"), "exit"), "block")).first()[0]
        if end is None:
            break
        number = end["before"] + end["n"]
        block, entry = (end["block"], -1 - end["exit"]) if end["exit"] < 0 else (end["block"] + 1, end["exit"])
        if number < 10**digits - 1 or block > last:
            break
        digits += 1
        parts.append(_followed(blocks, block, entry, digits, row_limit, byte_budget))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # A block in which the numbers grow longer has its starts in two parts.
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("before", "starts"))), lambda p: p["starts"]))
    return out.groupBy("block").agg(F.min("before").alias("before"), whole.alias("starts"))


def greedy_batches(
    df: DataFrame,
    order: Sequence[Column],
    cells: Column | None = None,
    row_limit: int = ROW_LIMIT,
    byte_budget: int = BYTE_BUDGET,
    partitions: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add ``batch_no, row_no, row_bytes``: the batches that one pass over all rows in `order` would cut.

    Unlike `assign_batches`, whose batches end with a range of rows, the numbers are the same for any
    number of partitions, and no batch is shorter than the limits ask for but the last. That costs
    a second look at the sizes and a join of the rows with their block's starts.
    """
    cells = canonical_cells(df) if cells is None else cells
    sized = df.withColumn("row_bytes", F.octet_length(F.to_json(cells)).cast("bigint"))
    numbered = number_rows(sized, order, "rn", partitions, unique)
    blocks = _blocks(numbered, row_limit)
    starts = write_scratch(batch_starts(blocks, row_limit, byte_budget), "starts")
    row = F.col("block") * row_limit
    begun = starts.select("block", "before", F.transform("starts", lambda s: row + s + 1).alias("first_rows"))
    # A batch that goes on from the block before has its last start there.
    carried = begun.filter(F.size("first_rows") > 0).select((F.col("block") + 1).alias("block"), F.element_at("first_rows", -1).alias("carried"))
    known = begun.join(carried, "block", "left").select("block", "before", F.concat(F.array("carried"), "first_rows").alias("first_rows"))
    placed = numbered.withColumn("block", F.expr(f"(rn - 1) div {row_limit}")).join(known, "block")
    in_block = F.aggregate("first_rows", F.lit(0), lambda n, first: n + F.when(first <= F.col("rn"), 1).otherwise(0))
    own = F.when(F.element_at("first_rows", 1).isNull(), in_block + 1).otherwise(in_block)
    placed = placed.withColumn("_at", own)
    return placed.select(
        *df.columns, "row_bytes", (F.col("before") + F.col("_at") - 1).alias("batch_no"), (F.col("rn") - F.element_at("first_rows", F.col("_at")) + 1).alias("row_no")
    )
