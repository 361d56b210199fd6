"""Run logs as JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.plans.history import LOG_FIELDS

# The closed set of log events.
EVENTS = (
    "cli_failed",
    "source_started",
    "business_date_invalid",
    "source_config_failed",
    "task_config_failed",
    "sql_shape_precheck_failed",
    "sql_shape_precheck_passed",
    "stage_changed",
    "mapping_precheck_failed",
    "range_check_executed",
    "run_opened",
    "batch_pushed",
    "commit_diagnosed",
    "abort_failed",
    "run_finished",
    "sink_started",
    "sink_unavailable",
    "http_response_failed",
)

_LINE_BITS = (1 << 33) - 1


def read_log(spark: SparkSession, path: str, record_pattern: str = r"([^/]+)\.jsonl$") -> DataFrame:
    """Log lines with ``run_record_id`` (from the file name) and ``pos`` (their place in the file).

    Lines that are no JSON object are skipped. ``pos`` is the file, the offset of the block a line
    was read in, then its place among the lines read from it, so a log may span several files
    and large files may be split.
    """
    raw = spark.read.text(path).select(
        "value",
        F.regexp_extract("_metadata.file_path", record_pattern, 1).alias("run_record_id"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_LINE_BITS)).alias("line"),
        ).alias("pos"),
    )
    return parse_log(raw)


def parse_log(raw: DataFrame) -> DataFrame:
    """Typed log fields from rows ``value, run_record_id, pos``."""
    is_object = F.coalesce(
        F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)
    )
    parsed = raw.filter(is_object).withColumn("_l", F.from_json("value", LOG_FIELDS, {"mode": "PERMISSIVE"}))
    return parsed.select("run_record_id", "pos", "_l.*")


def log_lines(events: DataFrame) -> DataFrame:
    """One JSON text per event in a column ``value``; absent fields are written as null."""
    common = ["ts", "level", "event", "run_id", "task"]
    fields = [*common, *[c for c in events.columns if c not in common]]
    return events.select(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"}).alias("value")
    )


# The record id of logs written by `record_path`.
RECORD_FOLDER = r"run_record_id=([^/]+)/"


def record_path(folder: str, run_record_id: str) -> str:
    """Where the log of one run record goes; read it with the `RECORD_FOLDER` pattern."""
    return f"{folder}/run_record_id={run_record_id}"


def write_log(events: DataFrame, path: str) -> None:
    """Write events as JSON Lines files."""
    log_lines(events).write.mode("append").text(path)
