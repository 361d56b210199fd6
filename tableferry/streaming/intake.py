"""Batch intake as a stream: payload files in, staged rows out.

A payload file lies under ``<incoming>/<run_id>/`` and holds one payload per line. Every
micro-batch writes its rows and a ledger of its batches under its own load folder, named by
query and epoch, so a micro-batch that is run again replaces its own output only. A batch sent
again, in the same or a later micro-batch, supersedes the earlier copy: the later file wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.functions import runs as run_functions
from tableferry.operators.numbering import sequence_gaps
from tableferry.operators.verify import batch_contiguity
from tableferry.scratch import scratch_path, write_scratch
from tableferry.sources.payload import parse_payloads, payload_rows
from tableferry.sources.files import child_names, exists, remove

# What tells the copies of a batch apart, in the order that decides which one is in force.
_COPY = ("arrived_at", "source_file", "source_block", "source_line", "load")
LEDGER_SCHEMA = (
    "batch_no bigint, arrived_at timestamp, source_file string, source_block bigint, "
    "source_line bigint, rows bigint, run_id string, load string"
)
QUARANTINE_SCHEMA = (
    "run_id string, batch_no bigint, source_file string, source_line bigint, value string, reason string"
)


def incoming(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The stream of payload lines with their file and its arrival time."""
    reader = spark.readStream.option("pathGlobFilter", "*.json")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(f"{folder}/*").select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def judge_lines(lines: DataFrame, run_states: DataFrame, columns: list[str]) -> DataFrame:
    """Parsed payload lines with a ``reason`` for each refused one.

    ``run_states``: run_id, sealed BOOLEAN. A batch of an unknown run or after the seal is late
    and refused, whatever its content. The states, one short row per run, go to the lines: dealt by
    run, all lines of a run would be one task.
    """
    parsed = parse_payloads(
        lines.withColumn("run_id", F.element_at(F.split("source_file", "/"), -2))
        .withColumn("source_line", F.monotonically_increasing_id()),
        len(columns),
    )
    known = run_states.select("run_id", "sealed")
    late = (
        F.when(~run_functions.is_run_id(F.col("run_id")) | F.col("sealed").isNull(), "RUN_UNKNOWN")
        .when(F.col("sealed"), "RUN_SEALED")
    )
    return (
        parsed.join(F.broadcast(known), "run_id", "left")
        .withColumn("reason", F.coalesce(late, F.col("reason")))
        .withColumnRenamed("seq", "batch_no")
        .drop("sealed")
    )


def write_load(judged: DataFrame, staging_path: str, columns: list[str], load: str) -> None:
    """Write one load: rows, ledger and quarantine, each replacing all that this load wrote before."""
    accepted = judged.filter(F.col("reason").isNull())
    rows = payload_rows(
        accepted.withColumnRenamed("batch_no", "seq"),
        columns,
        ("run_id", "arrived_at", "source_file", "source_block", "source_line"),
    )
    place = ("run_id", "batch_no", "arrived_at", "source_file", "source_block", "source_line")
    ledger = accepted.select(*place, F.size("rows").cast("bigint").alias("rows"))
    refused = judged.filter(F.col("reason").isNotNull()).select(
        "run_id", "batch_no", "source_file", "source_line", "value", "reason"
    )
    spark, quarantine = judged.sparkSession, f"{staging_path}/quarantine/load={load}"
    if exists(spark, quarantine):
        # An earlier attempt got this far, and may have staged runs of which this one refuses every row.
        for name in ("rows", "ledger"):
            for run in child_names(spark, f"{staging_path}/{name}"):
                remove(spark, f"{staging_path}/{name}/{run}/load={load}")
    refused.write.mode("overwrite").parquet(quarantine)
    for name, part in (("rows", rows), ("ledger", ledger)):
        (
            part.withColumn("load", F.lit(load))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id", "load")
            .parquet(f"{staging_path}/{name}")
        )


def start_intake(
    spark: SparkSession,
    folder: str,
    staging_path: str,
    run_states,
    columns: list[str],
    checkpoint: str,
    max_files: int | None = None,
):
    """Start the intake; it stops by itself once all files present have been taken in.

    ``run_states`` is a callable that returns the current run-state table, so a run sealed
    between two micro-batches is refused from then on.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        # One written copy of the judged lines: three outputs, one parse, and line numbers that
        # the rows and the ledger share.
        path = scratch_path(session, "intake")
        judged = write_scratch(judge_lines(batch, run_states(session), columns), "intake", path)
        try:
            write_load(judged, staging_path, columns, f"{query}-{epoch:012d}")
        finally:
            remove(session, path)

    return (
        incoming(spark, folder, max_files)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ledger(spark: SparkSession, staging_path: str) -> DataFrame:
    """Every batch copy received, one row each."""
    if not exists(spark, f"{staging_path}/ledger"):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{staging_path}/ledger")


def read_quarantine(spark: SparkSession, staging_path: str) -> DataFrame:
    if not exists(spark, f"{staging_path}/quarantine"):
        return spark.createDataFrame([], QUARANTINE_SCHEMA)
    return spark.read.schema(QUARANTINE_SCHEMA).parquet(f"{staging_path}/quarantine")


def received_batches(spark: SparkSession, staging_path: str) -> DataFrame:
    """The copy in force of every batch: ``run_id, batch_no, rows, ...``.

    Picked by an aggregation, so a batch that was sent very often is folded on the map side.
    """
    latest = F.max(F.struct(*_COPY, "rows")).alias("copy")
    return (
        read_ledger(spark, staging_path).groupBy("run_id", "batch_no").agg(latest)
        .select("run_id", "batch_no", "copy.*")
    )


def read_staged(spark: SparkSession, staging_path: str, columns: list[str]) -> DataFrame:
    """Staged rows without superseded copies.

    Only the superseded copies are joined against the rows, and they are few, so the rows
    themselves normally stay where they are.
    """
    cells = ", ".join(f"`{c}` string" for c in columns)
    schema = (
        "arrived_at timestamp, source_file string, source_block bigint, source_line bigint, batch_no bigint, "
        f"row_no bigint, {cells}, run_id string, load string"
    )
    if not exists(spark, f"{staging_path}/rows"):
        return spark.createDataFrame([], schema).select("run_id", "batch_no", "row_no", *columns)
    rows = spark.read.schema(schema).parquet(f"{staging_path}/rows")
    in_force = received_batches(spark, staging_path).select(
        "run_id", "batch_no", F.struct(*_COPY).alias("_in_force")
    )
    superseded = (
        read_ledger(spark, staging_path).join(in_force, ["run_id", "batch_no"])
        .filter(F.struct(*_COPY) < F.col("_in_force"))
        .select("run_id", "batch_no", *_COPY)
    )
    return rows.join(superseded, ["run_id", "batch_no", *_COPY], "left_anti").select(
        "run_id", "batch_no", "row_no", *columns
    )


def intake_report(spark: SparkSession, staging_path: str, expected: DataFrame) -> DataFrame:
    """Contiguity per run at commit: ``expected`` holds run_id, source_batches."""
    return batch_contiguity(received_batches(spark, staging_path), expected)


def intake_gaps(spark: SparkSession, staging_path: str) -> DataFrame:
    """Where the received numbers of a run jump: ``run_id, expected, got``."""
    return sequence_gaps(received_batches(spark, staging_path))


class RunSealed(RuntimeError):
    """The run was sealed; its staging may not be dropped any more."""


def abort_run(spark: SparkSession, staging_path: str, run_states: DataFrame, run_id: str) -> bool:
    """Drop the staging of an unsealed run. Repeating it is harmless; a sealed run is refused."""
    state = run_states.filter(F.col("run_id") == run_id).select("sealed").first()
    if state is not None and state["sealed"]:
        raise RunSealed(f"run {run_id} is sealed")
    dropped = False
    for part in ("rows", "ledger"):
        dropped = remove(spark, f"{staging_path}/{part}/run_id={run_id}") or dropped
    return dropped
