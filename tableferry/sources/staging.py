"""Staging area of a run: Parquet files under ``run_id=`` folders.

A write job commits all or nothing. Writing a run (or a batch) again replaces exactly that run
(or batch), so a repeat after an unknown outcome leaves one copy.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tableferry.operators.numbering import assign_batches
from tableferry.scratch import SHORT_LIVED
from tableferry.sources.files import child_names, remove


class Sent(NamedTuple):
    """What the staging job counted: rows read, rows written, batches cut."""

    rows: int
    written: int
    batches: int


def stage_run(df: DataFrame, path: str, run_id: str) -> Sent:
    """Write all rows of a run, replacing an earlier attempt.

    The source count comes from the write itself, not from a second scan.
    """
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    observed.write.mode("overwrite").options(**SHORT_LIVED).parquet(f"{path}/run_id={run_id}")
    rows = int(seen.get["rows"])
    return Sent(rows, rows, 0)


def stage_batches(df: DataFrame, path: str, run_id: str, order: Sequence[Column]) -> tuple[Sent, DataFrame]:
    """Like `stage_run`, in numbered batches: what was counted, and the staged rows with
    ``batch_no, row_no, row_bytes``. The batches are counted as they are cut, by their first rows."""
    seen, cut = Observation(), Observation()
    staged = assign_batches(df, order, path=f"{path}/run_id={run_id}", seen=seen, cut=cut)
    return Sent(int(seen.get["rows"]), int(cut.get["rows"]), int(cut.get["batches"])), staged


def replace_batches(df: DataFrame, path: str) -> None:
    """Write rows with ``run_id, batch_no``; each batch present replaces its earlier copy."""
    (
        df.repartition("run_id", "batch_no")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "batch_no")
        .parquet(path)
    )


def read_run(spark: SparkSession, path: str, run_id: str, schema) -> DataFrame:
    """Staged rows of a run in the staged layout; only that run's folder is read."""
    return spark.read.schema(schema).parquet(f"{path}/run_id={run_id}")


def staged_runs(spark: SparkSession, path: str) -> list[str]:
    """Run ids that have staged data."""
    return [n.split("=", 1)[1] for n in child_names(spark, path) if n.startswith("run_id=")]


def drop_run(spark: SparkSession, path: str, run_id: str) -> bool:
    """Remove a run's staged data; repeating it is harmless. Returns whether data was there."""
    return remove(spark, f"{path}/run_id={run_id}")
