"""Written tables that cut lineage, kept in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tableferry.sources.files import remove


# Data that is read back once or twice: dictionaries would cost more time than they save.
SHORT_LIVED = {"parquet.enable.dictionary": "false", "compression": "zstd"}


def scratch_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir`, which every executor can reach.

    Only a local session without the setting gets a machine-local folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tableferry-"))
    return context.getCheckpointDir()


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/tableferry/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table of this application."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> bool:
    """Remove every intermediate table of this application, once nothing reads them any more."""
    return remove(spark, _application_folder(spark))


def write_scratch(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write `df` once and read it back: later jobs see the same rows, also after lost executors.

    A given `path` is replaced; without one the table goes to a new scratch folder.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").options(**SHORT_LIVED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a plain file scan this is the size on disk."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
