"""The run table as a stream over run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableferry.plans.history import FOLD_MEMBERS, combine_states, fold_states, join_accepted, merge_states
from tableferry.streaming.epochs import EpochFolders


def log_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """Log lines as they arrive; ``schema`` names run_record_id, pos and the log fields."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def start_live_runs(lines: DataFrame, states_path: str, checkpoint: str, fan: int = 10):
    """Fold the lines of each micro-batch into one state for each (record, run id) and write those.

    States of two sets of lines merge into that of both, so the stream keeps none: a run that has ended costs
    nothing, and a line that comes days later still counts. The folders written are merged as `EpochFolders` does.
    Repeating an epoch replaces it, and a query with a new checkpoint replaces nothing: its states stay apart.
    """
    folders = EpochFolders(states_path, fan)

    def save(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        states = fold_states(batch).withColumns({"query": F.lit(query), "written_at": F.current_timestamp()})
        folders.write(states, query, epoch, _merged_by_query)

    return (
        lines.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _merged_by_query(states: DataFrame) -> DataFrame:
    return merge_states(states, "query", last=["written_at"])


def live_states(spark: SparkSession, states_path: str) -> DataFrame:
    """State of every (record, run id): that of the query which saw the last line, of equal ones the one written last.

    A query that starts over, and is still behind, doesn't hide what an earlier one found.
    """
    seen = F.greatest(*[F.col(f"{member}.pos") for member in FOLD_MEMBERS])
    newest = Window.partitionBy("run_record_id", "run_id").orderBy(
        seen.desc_nulls_last(), F.col("written_at").desc(), F.col("query").desc()
    )
    return (
        _merged_by_query(EpochFolders(states_path).read(spark))
        .withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1")
        .drop("_rank", "query", "written_at")
    )


def live_runs(spark: SparkSession, states_path: str, accepted: DataFrame | None = None) -> DataFrame:
    """The run table so far: folded rows, joined with the accepted runs when given.

    FileNotFoundError before the first micro-batch has ended.
    """
    folded = combine_states(live_states(spark, states_path))
    return folded if accepted is None else join_accepted(accepted, folded)
