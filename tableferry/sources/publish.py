"""All-or-nothing publishing of a table: write a new version, check it, switch one pointer.

A target is any object with ``read(spark)``, ``affected(spark, staged, version)``,
``publish(df, run_id, check, based_on)`` and ``current(spark)``. Readers resolve the pointer first, so they see the old table or the new one;
the pointer also tells whether a run was published when its answer was lost.

A version follows exactly one other. Before the switch a run claims to follow the version that its rows
were made from; the claim is a file or table that only one run can create. A run that finds another
version current, or the claim taken, fails with `TargetBusy` and leaves the target and all other runs' versions
alone. A run that dies between claim and switch leaves its claim; `release` removes it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tableferry.sources.files import child_names, create_once, exists, read_text, remove, replace_text

POINTER = "CURRENT"


# Published files: columns of mostly distinct values give up their dictionary early.
PUBLISHED = {"compression": "zstd", "parquet.dictionary.page.size": "131072"}


class TargetBusy(RuntimeError):
    """Another run published, or is about to, after this run read the target."""

    kind = "TARGET_BUSY"

    def __init__(self, table: str, based_on: str | None):
        super().__init__(f"TARGET_BUSY: {table} has moved on from version {based_on}")


#: Says that the rows are made from whatever version is current when publishing begins.
CURRENT_VERSION = "\0current"


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form Catalyst knows to be empty: joins against it disappear from the plan."""
    return spark.createDataFrame([], schema).limit(0)


def current_version(spark: SparkSession, table: str) -> str | None:
    """Run id of the published version, None before the first publish."""
    text = read_text(spark, f"{table}/{POINTER}")
    return None if text is None else text.strip()


def read_current(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The published table; empty with the given schema before the first publish."""
    version = current_version(spark, table)
    if version is None:
        return empty_table(spark, schema)
    return spark.read.schema(schema).parquet(f"{table}/versions/{version}")


def publish(
    df: DataFrame, table: str, run_id: str, check: Callable[[], None] | None = None, based_on: str | None = CURRENT_VERSION
) -> None:
    """Write `df` as version `run_id`, run `check`, then switch the pointer from version `based_on`.

    If the write or the check fails, or another run came first, the pointer still names the version it named and the
    new folder is removed. The previous version is kept for readers that already resolved it; versions that were
    followed before are removed. Versions that are still being written by other runs stay.
    """
    spark = df.sparkSession
    version = f"{table}/versions/{run_id}"
    previous = current_version(spark, table)
    if previous == run_id:
        raise ValueError(f"run {run_id} is already published")
    if based_on != CURRENT_VERSION and based_on != previous:
        raise TargetBusy(table, based_on)
    claim = _claim(table, previous)
    claimed = False
    try:
        df.write.mode("overwrite").options(**PUBLISHED).parquet(version)
        if check is not None:
            check()
        claimed = create_once(spark, claim, run_id)
        if not claimed or current_version(spark, table) != previous:
            raise TargetBusy(table, previous)
        replace_text(spark, f"{table}/{POINTER}", run_id, run_id)
    except BaseException:
        if current_version(spark, table) != run_id:
            remove(spark, version)
            if claimed:
                remove(spark, claim)
        raise
    for name in child_names(spark, f"{table}/versions"):
        if name not in (run_id, previous) and exists(spark, _claim(table, name)):
            remove(spark, f"{table}/versions/{name}")


def _claim(table: str, version: str | None) -> str:
    return f"{table}/claims/after-{version or 'nothing'}"


def release(spark: SparkSession, table: str) -> bool:
    """Remove the claim on the current version that a dead run left; only when no run is publishing."""
    return remove(spark, _claim(table, current_version(spark, table)))


@dataclass(frozen=True)
class FolderTarget:
    """Parquet folders: ``<path>/versions/<run_id>/`` and the pointer file ``<path>/CURRENT``."""

    path: str
    schema: T.StructType
    keeps_buckets = False

    def read(self, spark: SparkSession) -> DataFrame:
        return read_current(spark, self.path, self.schema)

    def affected(self, spark: SparkSession, staged: DataFrame, version: str | None) -> tuple[DataFrame, int]:
        """What a publish rewrites, here the whole table, and the number of rows that stay as they lie."""
        return self.read(spark), 0

    def current(self, spark: SparkSession) -> str | None:
        return current_version(spark, self.path)

    def publish(
        self, df: DataFrame, run_id: str, check: Callable[[], None] | None = None, based_on: str | None = CURRENT_VERSION
    ) -> None:
        publish(df, self.path, run_id, check, based_on)


@dataclass(frozen=True)
class BucketedTarget:
    """Catalog tables ``<name>__v_<run_id>`` in buckets of the key, behind the view ``<name>``.

    The buckets keep the target where it lies: an upsert shuffles only the staged rows into the
    target's buckets, and every task of the join writes one bucket of the new version. Choose
    the number of buckets for the size of the table (some hundred MiB each).
    """

    name: str
    schema: T.StructType
    key: Sequence[str]
    buckets: int
    keeps_buckets = True

    def _version(self, run_id: str) -> str:
        return f"{self.name}__v_{run_id}"

    def current(self, spark: SparkSession) -> str | None:
        if not spark.catalog.tableExists(self.name):
            return None
        text = spark.sql(f"SHOW CREATE TABLE {self.name}").first()[0]
        return re.search(r"__v_([0-9a-zA-Z_]+)", text).group(1)

    def read(self, spark: SparkSession) -> DataFrame:
        run_id = self.current(spark)
        if run_id is None:
            return empty_table(spark, self.schema)
        return spark.table(self._version(run_id))

    def affected(self, spark: SparkSession, staged: DataFrame, version: str | None) -> tuple[DataFrame, int]:
        """What a publish rewrites, here the whole table, and the number of rows that stay as they lie."""
        return self.read(spark), 0

    def _claim(self, run_id: str | None) -> str:
        return f"{self.name}__after_{run_id or 'nothing'}"

    def release(self, spark: SparkSession) -> None:
        """Remove the claim on the current version that a dead run left; only when no run is publishing."""
        spark.sql(f"DROP TABLE IF EXISTS {self._claim(self.current(spark))}")

    def publish(
        self, df: DataFrame, run_id: str, check: Callable[[], None] | None = None, based_on: str | None = CURRENT_VERSION
    ) -> None:
        spark, version = df.sparkSession, self._version(run_id)
        previous = self.current(spark)
        if previous == run_id:
            raise ValueError(f"run {run_id} is already published")
        if based_on != CURRENT_VERSION and based_on != previous:
            raise TargetBusy(self.name, based_on)
        if previous is None:
            # The first version comes in any order; later ones come bucket by bucket from the join.
            df = df.repartition(self.buckets, *self.key)
        claimed = False
        try:
            writer = df.write.bucketBy(self.buckets, *self.key).sortBy(*self.key)
            writer.options(**PUBLISHED).mode("overwrite").format("parquet").saveAsTable(version)
            if check is not None:
                check()
            try:
                spark.sql(f"CREATE TABLE {self._claim(previous)} (run_id STRING) USING parquet")
            except AnalysisException as error:
                if error.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                    raise
                raise TargetBusy(self.name, previous) from error
            claimed = True
            if self.current(spark) != previous:
                raise TargetBusy(self.name, previous)
            spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT * FROM {version}")
        except BaseException:
            if self.current(spark) != run_id:
                spark.sql(f"DROP TABLE IF EXISTS {version}")
                if claimed:
                    spark.sql(f"DROP TABLE IF EXISTS {self._claim(previous)}")
            raise
        self._drop_old(spark, keep={run_id, previous})

    def _drop_old(self, spark: SparkSession, keep: set) -> None:
        """Drop the versions that another one has followed, with the claims on them."""
        database, _, table = self.name.rpartition(".")
        owner, prefix = f"{database}." if database else "", f"{table}__v_".lower()
        for found in spark.catalog.listTables(database or None, f"{table}__v_*"):
            run_id = found.name[len(prefix):]
            if found.name.lower().startswith(prefix) and run_id not in keep and spark.catalog.tableExists(self._claim(run_id)):
                spark.sql(f"DROP TABLE IF EXISTS {owner}{found.name}")
                spark.sql(f"DROP TABLE IF EXISTS {self._claim(run_id)}")
