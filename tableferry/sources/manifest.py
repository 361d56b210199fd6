"""A target in buckets of its key, published by a manifest: a run rewrites only the buckets it touches.

Under the target's path lie ``data/run=<run>/bucket__=<n>/`` folders, one text file
``manifests/<run>.json`` for each version, which names the folder of every bucket and its rows, and
the pointer file ``CURRENT``. Readers resolve the pointer, then the manifest. A publish writes the
touched buckets as new folders and a manifest in which all others stay as they are, and switches the
pointer. Runs that overlap and touch different buckets both succeed: the later one puts its buckets
into the manifest that the earlier one left. When they share a bucket the later one fails with
`TargetBusy`. The claim that orders them needs a store with atomic create and rename.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.sources.files import child_names, create_once, read_text, remove, replace_text
from tableferry.sources.publish import CURRENT_VERSION, POINTER, PUBLISHED, TargetBusy, current_version, empty_table

BUCKET = "bucket__"
#: Hexadecimal digits of a key's hash that choose its bucket, and what separates its columns.
_DIGITS, _BETWEEN = 12, "\x1f"


def bucket_number(key: Sequence[Column], buckets: int) -> Column:
    """The bucket of a key: from the MD5 of its texts, so that any engine gives the same."""
    joined = F.concat_ws(_BETWEEN, *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    number = F.conv(F.substring(F.md5(joined), 1, _DIGITS), 16, 10).cast("bigint")
    return (number % buckets).cast("int")


@dataclass(frozen=True)
class ManifestTarget:
    """Choose `buckets` for the size of the table: some hundred MiB each. A manifest is as long as there are buckets."""

    path: str
    schema: T.StructType
    key: Sequence[str]
    buckets: int
    keeps_buckets = False

    def _bucket(self, df: DataFrame) -> Column:
        """Keys are spelled as the target spells them, whatever type they come in."""
        return bucket_number([F.col(k).cast(self.schema[k].dataType) for k in self.key], self.buckets)

    def current(self, spark: SparkSession) -> str | None:
        return current_version(spark, self.path)

    def _manifest(self, spark: SparkSession, version: str | None) -> dict:
        """``run_id, follows, buckets``: bucket number to folder and rows."""
        text = None if version is None else read_text(spark, f"{self.path}/manifests/{version}.json")
        return {"run_id": None, "follows": None, "buckets": {}} if text is None else json.loads(text)

    def entries(self, spark: SparkSession, version: str | None) -> dict[int, tuple[str, int]]:
        return {int(b): (folder, rows) for b, (folder, rows) in self._manifest(spark, version)["buckets"].items()}

    def _rows(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return empty_table(spark, self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}" for folder in sorted(folders)])

    def read(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, [folder for folder, _ in self.entries(spark, self.current(spark)).values()])

    def affected(self, spark: SparkSession, staged: DataFrame, version: str | None) -> tuple[DataFrame, int]:
        """The rows of the buckets that staged keys fall in, and the number of rows in all others."""
        entries = self.entries(spark, version)
        touched = {r[0] for r in staged.select(self._bucket(staged)).distinct().collect()} if entries else set()
        here = [folder for b, (folder, _) in entries.items() if b in touched]
        return self._rows(spark, here), sum(rows for b, (_, rows) in entries.items() if b not in touched)

    def _claim(self, version: str | None) -> str:
        return f"{self.path}/claims/after-{version or 'nothing'}"

    def published(self, spark: SparkSession, run_id: str) -> bool:
        """Whether this run's version was ever switched to."""
        current = self.current(spark)
        if current == run_id:
            return True
        for name in child_names(spark, f"{self.path}/claims"):
            # A claim without a switch still waits at the version it claims to follow.
            if name != f"after-{current or 'nothing'}" and read_text(spark, f"{self.path}/claims/{name}") == run_id:
                return True
        return False

    def release(self, spark: SparkSession) -> bool:
        """Remove the claim on the current version that a dead run left; only when no run is publishing."""
        return remove(spark, self._claim(self.current(spark)))

    def publish(
        self, df: DataFrame, run_id: str, check: Callable[[], None] | None = None, based_on: str | None = CURRENT_VERSION
    ) -> None:
        """Replace the buckets that `df` has rows of by these rows, all at once.

        `df` holds everything that these buckets are to hold, as `upsert` of `affected` rows gives it.
        """
        spark = df.sparkSession
        if self.published(spark, run_id):
            raise ValueError(f"run {run_id} is already published")
        base = self.current(spark) if based_on == CURRENT_VERSION else based_on
        folder = f"data/run={run_id}"
        try:
            dealt = df.select(*self.schema.names, self._bucket(df).alias(BUCKET)).repartition(BUCKET)
            dealt.write.mode("overwrite").options(**PUBLISHED).partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            if check is not None:
                check()
            previous = self._switch(spark, run_id, base, self._written(spark, folder))
        except BaseException:
            current = self.current(spark)
            if current != run_id:
                if read_text(spark, self._claim(current)) == run_id:
                    remove(spark, self._claim(current))
                remove(spark, f"{self.path}/{folder}")
                remove(spark, f"{self.path}/manifests/{run_id}.json")
            raise
        self._drop_old(spark, run_id, previous)

    def _written(self, spark: SparkSession, folder: str) -> dict[int, tuple[str, int]]:
        """Entries of the buckets just written; a row count for each bucket, from the files."""
        if not any(name.startswith(BUCKET) for name in child_names(spark, f"{self.path}/{folder}")):
            return {}
        files = spark.read.schema(f"{BUCKET} int").parquet(f"{self.path}/{folder}")
        return {r[0]: (f"{folder}/{BUCKET}={r[0]}", r[1]) for r in files.groupBy(BUCKET).count().collect()}

    def _switch(self, spark: SparkSession, run_id: str, base: str | None, written: dict[int, tuple[str, int]]) -> str | None:
        """Point to a manifest with the written buckets; returns the version before it."""
        seen = self.entries(spark, base)
        while True:
            current = self.current(spark)
            entries = self.entries(spark, current)
            if any(entries.get(b) != seen.get(b) for b in written):
                raise TargetBusy(self.path, base)
            buckets = {b: list(e) for b, e in sorted((entries | written).items())}
            manifest = {"run_id": run_id, "follows": current, "buckets": buckets}
            replace_text(spark, f"{self.path}/manifests/{run_id}.json", json.dumps(manifest), "new")
            # A claim of this run is that of an earlier attempt, which died before the switch.
            if create_once(spark, self._claim(current), run_id) or read_text(spark, self._claim(current)) == run_id:
                replace_text(spark, f"{self.path}/{POINTER}", run_id, run_id)
                return current
            if self.current(spark) == current:
                # Another run holds the claim and has not switched yet.
                raise TargetBusy(self.path, current)

    def _drop_old(self, spark: SparkSession, run_id: str, previous: str | None) -> None:
        """Remove what only versions before the previous one show; the previous one is kept for its readers."""
        before = self._manifest(spark, previous)
        if before["follows"] is None:
            return
        old, live = self._manifest(spark, before["follows"]), set()
        for manifest in (before, self._manifest(spark, run_id)):
            live |= {folder for folder, _ in manifest["buckets"].values()}
        for folder, _ in old["buckets"].values():
            if folder not in live:
                remove(spark, f"{self.path}/{folder}")
        remove(spark, f"{self.path}/manifests/{before['follows']}.json")
