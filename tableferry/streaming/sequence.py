"""The sequence gate as a stream: which batch numbers a run has received, as keyed state.

The numbers of a run are cut into blocks of fixed width, and the state of a block is the sorted list of
its intervals of received numbers. A number that goes on from an interval lengthens it, so a block has
one interval more than it has gaps, and batches out of order cost nothing once their gap is closed. No
state outgrows its block, and the blocks of one run are dealt over all tasks; a reader joins intervals
that touch where blocks meet.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableferry.streaming.epochs import EpochFolders

# What runs on executors is sent by value: they need numpy and pandas but not this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GATE_SCHEMA = "run_id string, expected bigint, got bigint, intervals bigint"
STATE_SCHEMA = "starts array<bigint>, stops array<bigint>"
_HELD_SCHEMA = f"run_id string, block bigint, received bigint, {STATE_SCHEMA}"

#: Numbers of one block.
BLOCK = 1 << 16


def with_numbers(starts: np.ndarray, stops: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals (both ends included) joined with single numbers, merged where they touch."""
    numbers = np.unique(numbers)
    breaks = np.flatnonzero(np.diff(numbers) > 1) if len(numbers) else np.zeros(0, np.int64)
    new_starts, new_stops = numbers[np.append(0, breaks + 1)] if len(numbers) else numbers, numbers[np.append(breaks, -1)] if len(numbers) else numbers
    starts, stops = np.concatenate((starts, new_starts)), np.concatenate((stops, new_stops))
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order]) if len(stops) else stops
    apart = np.append(True, starts[1:] > reach[:-1] + 1)[: len(starts)]
    last = np.append(apart[1:], True)[: len(starts)]
    return starts[apart], reach[last]


def refusals(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int | None]]:
    """(expected, got): the next number of the run, and for every gap what was expected and what came."""
    nothing = not len(starts) or starts[0] != 1
    rows = [(1 if nothing else int(stops[0]) + 1, None)]
    before = [0, *stops.tolist()]
    return rows + [(b + 1, int(s)) for b, s in zip(before, starts.tolist()) if s != b + 1]


def _gate(key: tuple, pieces: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else ([], [])
    starts, stops = (np.array(x, np.int64) for x in held)
    for piece in pieces:
        starts, stops = with_numbers(starts, stops, piece["batch_no"].to_numpy(np.int64))
    state.update((starts.tolist(), stops.tolist()))
    received = int((stops - starts + 1).sum())
    yield pd.DataFrame({"run_id": [key[0]], "block": [key[1]], "received": [received], "starts": [starts], "stops": [stops]})


def _latest(rows: DataFrame) -> DataFrame:
    """Of every block of a query the row of its last epoch; what a query has received only grows."""
    held = F.struct("received", "epoch", "starts", "stops")
    last = rows.groupBy("run_id", "query", "block").agg(F.max_by(held, F.struct("received", "epoch")).alias("held"))
    return last.select("run_id", "query", "block", "held.*")


def _in_force(rows: DataFrame) -> DataFrame:
    """The blocks of every run from the query that has received most of it."""
    blocks = _latest(rows)
    queries = blocks.groupBy("run_id", "query").agg(F.struct(F.sum("received"), F.max("epoch"), "query").alias("version"))
    chosen = queries.groupBy("run_id").agg(F.max_by("query", "version").alias("query"))
    return blocks.join(chosen, ["run_id", "query"], "left_semi").select("run_id", "block", "starts", "stops")


def start_gate(batches: DataFrame, path: str, checkpoint: str, fan: int = 10):
    """Follow a stream of (run_id, batch_no); ends once all that is there has been taken in.

    After each micro-batch, the blocks that received something are written with their intervals to a folder of the epoch;
    other blocks of their runs are not written again. Numbers sent again change nothing, and an epoch that is run again
    replaces its folder. Folders are merged as `EpochFolders` does. A query with a new checkpoint replaces nothing and
    counts for the runs of which it has received more. Checkpoints and folders of gates that kept one state for a run
    can't be gone on with.
    """
    folders = EpochFolders(path, fan)

    def save(changed: DataFrame, epoch: int) -> None:
        query = changed.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        stamped = changed.withColumns({"epoch": F.lit(epoch).cast("bigint"), "query": F.lit(query)})
        folders.write(stamped, query, epoch, _latest)

    return (
        batches.select("run_id", "batch_no").filter("run_id IS NOT NULL AND batch_no > 0")
        .withColumn("block", F.expr(f"(batch_no - 1) div {BLOCK}"))
        .groupBy("run_id", "block")
        .applyInPandasWithState(_gate, _HELD_SCHEMA, STATE_SCHEMA, "update", "NoTimeout")
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def gate_state(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, expected, got, intervals) of every run as of its last micro-batch; no rows before the first has ended.

    One row of a run has the number expected next and no `got`; one row for each gap has the number expected there and
    the one that came.
    """
    folders = EpochFolders(path)
    if not folders.pieces(spark):
        return spark.createDataFrame([], GATE_SCHEMA)
    blocks = _in_force(folders.read(spark))
    run = Window.partitionBy("run_id")
    # A row for each block, without its intervals: few enough for a window over a run.
    ends = blocks.select("run_id", "block", F.get("starts", F.lit(0)).alias("start"), F.element_at("stops", -1).alias("stop"), F.size("starts").alias("n"))
    ends = ends.withColumn("before", F.coalesce(F.lag("stop").over(run.orderBy("block")), F.lit(0).cast("bigint")))
    joined = F.expr("if(start = before + 1 AND before > 0, 1, 0)")
    ends = ends.withColumn("intervals", F.sum(F.col("n") - joined).over(run)).select("run_id", "block", "before", "stop", "intervals")
    placed = blocks.join(ends, ["run_id", "block"])
    befores = F.concat(F.array("before"), F.slice("stops", 1, F.size("stops") - 1))
    jumps = F.filter(
        F.zip_with(befores, "starts", lambda b, s: F.struct((b + 1).alias("expected"), s.alias("got"))), lambda j: j["expected"] != j["got"]
    )
    placed = placed.select("run_id", "stop", "intervals", jumps.alias("jumps"))
    following = F.coalesce(F.min(F.get("jumps", F.lit(0))["expected"]), F.max("stop") + 1).alias("expected")
    following = placed.groupBy("run_id").agg(following, F.any_value("intervals").alias("intervals"))
    return following.select("run_id", "expected", F.lit(None).cast("bigint").alias("got"), "intervals").unionByName(
        placed.select("run_id", "intervals", F.inline("jumps")).select("run_id", "expected", "got", "intervals")
    )
