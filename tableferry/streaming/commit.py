"""From intake to target: the durable states of a run, its gate and its publish.

A run is OPEN, then SEALED, then PUBLISHED or ABORTED; an open run may be aborted too. Every state is
one numbered file that only one caller can create, so of two callers that move a run at once one
fails, and the stream, the gate and the publish act on the same state. The stream refuses batches of a run that
is not open. Every step can be repeated: what died after a step goes on from the state it left (`recover`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.operators import upsert as merge
from tableferry.operators.range_audit import reject_rows
from tableferry.operators.verify import batch_contiguity, verify_gate
from tableferry.plans.copy_run import SINK_CODES, cast_rules
from tableferry.plans.run_log import RunLog
from tableferry.sources.files import child_names, create_whole, exists, read_text, remove
from tableferry.sources.publish import TargetBusy
from tableferry.streaming.intake import LEDGER_SCHEMA, RunSealed, read_staged, received_batches

OPEN, SEALED, PUBLISHED, ABORTED = "OPEN", "SEALED", "PUBLISHED", "ABORTED"
_NEXT = {None: {OPEN}, OPEN: {SEALED, ABORTED}, SEALED: {PUBLISHED, ABORTED}, PUBLISHED: set(), ABORTED: set()}


class RunUnknown(RuntimeError):
    """No such run was opened."""


class StateMoved(RuntimeError):
    """Another caller moved the run first."""


class CommitRefused(RuntimeError):
    """The run was discarded and the target left alone; `kind` says why, `numbers` holds the gate's five numbers."""

    def __init__(self, kind: str, message: str, numbers: dict[str, int]):
        self.kind, self.numbers = kind, numbers
        super().__init__(f"{kind}: {message}")


@dataclass(frozen=True)
class RunStates:
    """The state files ``<folder>/run_id=<run>/<n>.json``; the highest number is in force."""

    spark: SparkSession
    folder: str

    def _run(self, run_id: str) -> str:
        return f"{self.folder}/run_id={run_id}"

    def last(self, run_id: str) -> tuple[int, dict]:
        """Number and content of the state in force; 0 and no state for an unknown run."""
        names = [n for n in child_names(self.spark, self._run(run_id)) if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return 0, {"state": None}
        return int(names[-1].split(".")[0]), json.loads(read_text(self.spark, f"{self._run(run_id)}/{names[-1]}"))

    def move(self, run_id: str, to: str, **details) -> None:
        """Compare and set: the state after the one in force, if the run may go there from it."""
        number, now = self.last(run_id)
        if to not in _NEXT[now["state"]]:
            if now["state"] is None:
                raise RunUnknown(f"RUN_UNKNOWN: {run_id}")
            raise RunSealed(f"RUN_SEALED: run {run_id} is {now['state']}")
        text = json.dumps({"state": to, **details})
        if not create_whole(self.spark, f"{self._run(run_id)}/{number + 1:06d}.json", text, uuid.uuid4().hex):
            raise StateMoved(f"run {run_id} is no longer {now['state']}")

    def open(self, run_id: str) -> None:
        self.move(run_id, OPEN)

    def table(self, spark: SparkSession | None = None) -> DataFrame:
        """(run_id, state, sealed) of every run, as the stream asks for it; read by executors."""
        spark = spark or self.spark
        if not exists(spark, self.folder):
            return spark.createDataFrame([], "run_id string, state string, sealed boolean")
        files = spark.read.schema("state string, run_id string").json(self.folder).select("run_id", "state", F.col("_metadata.file_name").alias("file"))
        newest = files.groupBy("run_id").agg(F.max_by("state", "file").alias("state"))
        return newest.withColumn("sealed", F.col("state") != OPEN)


@dataclass(frozen=True)
class IntakeCommit:
    """Runs of one target: `columns` are the staged cells in order, under the target's names; `key` is the target's."""

    spark: SparkSession
    states: RunStates
    staging_path: str
    target: object
    columns: Sequence[str]
    key: Sequence[str]
    log_folder: str | None = None

    def commit(self, run_id: str, total_rows: int, total_batches: int) -> dict:
        """Seal the run, check that all that was sent has arrived, publish. A run is committed once.

        Gives the five numbers and the effects. A run that fails is discarded, staging included, and the target
        keeps its version (`CommitRefused`); a run that is sealed already is refused (`RunSealed`).
        """
        self.states.move(run_id, SEALED, source_rows=total_rows, source_batches=total_batches)
        return self.finish(run_id)

    def finish(self, run_id: str) -> dict:
        """What follows the seal, from wherever it stopped."""
        _, now = self.states.last(run_id)
        if now["state"] == SEALED:
            numbers = self._numbers(run_id, now)
            if self._published(run_id):
                # The switch was the last thing done: only the state is missing.
                self.states.move(run_id, PUBLISHED, **numbers)
            else:
                self._gate(run_id, numbers)
                self.states.move(run_id, PUBLISHED, **numbers, **self._publish(run_id, numbers))
            self._log(run_id, "SUCCEEDED", numbers)
        elif now["state"] not in (PUBLISHED, ABORTED):
            raise RunUnknown(f"run {run_id} is not sealed")
        self._drop(run_id)
        return {k: v for k, v in self.states.last(run_id)[1].items()}

    def abort(self, run_id: str) -> bool:
        """Discard an open run; whether there was staging to drop. Unknown and aborted runs change nothing."""
        _, now = self.states.last(run_id)
        if now["state"] not in (None, ABORTED):
            self.states.move(run_id, ABORTED)
        return self._drop(run_id)

    def recover(self) -> list[str]:
        """Finish the runs that a dead process left sealed or undropped; gives their ids. A run that is discarded on
        the way counts as finished."""
        stopped = self.states.table().filter(F.col("state") != OPEN).select("run_id", "state").collect()
        staged = set(child_names(self.spark, f"{self.staging_path}/ledger"))
        done = []
        for run_id, state in sorted(map(tuple, stopped)):
            if state == SEALED or f"run_id={run_id}" in staged:
                try:
                    self.finish(run_id)
                except CommitRefused:
                    pass
                done.append(run_id)
        return done

    def _published(self, run_id: str) -> bool:
        asked = getattr(self.target, "published", None)
        return self.target.current(self.spark) == run_id if asked is None else asked(self.spark, run_id)

    def _received(self, run_id: str) -> DataFrame:
        if not exists(self.spark, f"{self.staging_path}/ledger"):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return received_batches(self.spark, self.staging_path).filter(F.col("run_id") == run_id)

    def _staged(self, run_id: str) -> DataFrame:
        return read_staged(self.spark, self.staging_path, list(self.columns)).filter(F.col("run_id") == run_id)

    def _numbers(self, run_id: str, sealed: dict) -> dict[str, int]:
        received = self._received(run_id).agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        return {
            "source_rows": sealed["source_rows"], "source_batches": sealed["source_batches"], "staged_rows": self._staged(run_id).count(),
            "sink_reported_rows": received[1], "received_batches": received[0],
        }

    def _gate(self, run_id: str, numbers: dict[str, int]) -> None:
        one = self.spark.range(1)
        judged = verify_gate(one.select(*[F.lit(n).cast("bigint").alias(name) for name, n in numbers.items()])).first()
        shown = ", ".join(f"{name} {n}" for name, n in numbers.items())
        if judged["verdict"] != "PASSED":
            self._discard(run_id, "VERIFY_FAILED", f"{judged['cause']}: {shown}", numbers, cause=judged["cause"])
        expected = one.select(F.lit(run_id).alias("run_id"), F.lit(numbers["source_batches"]).cast("bigint").alias("source_batches"))
        if not batch_contiguity(self._received(run_id), expected).first()["contiguous"]:
            self._discard(run_id, "VERIFY_FAILED", f"the batches are not 1 to N: {shown}", numbers, cause="BATCH_NOT_DELIVERED")
        staged = self._staged(run_id).select(*self.columns)
        refused = reject_rows(staged, self.key, cast_rules(staged, self.target.schema)).limit(1).count()
        report = merge.key_report(staged, self.key).first()
        if refused or report["null_key_rows"] or report["duplicated_keys"]:
            self._discard(run_id, "DATA_REJECTED", "values that the target would refuse, or keys that are missing or repeated", numbers)

    def _publish(self, run_id: str, numbers: dict[str, int]) -> dict[str, int]:
        staged = self._staged(run_id).select(*self.columns)
        based_on = self.target.current(self.spark)
        old, untouched = self.target.affected(self.spark, staged, based_on)
        merged = merge.upsert(old, staged, self.key, keep_buckets=self.target.keeps_buckets)
        try:
            self.target.publish(merged.drop("_effect"), run_id, None, based_on)
        except TargetBusy as busy:
            self._discard(run_id, busy.kind, str(busy), numbers)
        return {"untouched": untouched}

    def _discard(self, run_id: str, kind: str, message: str, numbers: dict[str, int], **details) -> None:
        self.states.move(run_id, ABORTED, kind=kind, **numbers, **details)
        self._log(run_id, "FAILED", numbers, kind, message)
        self._drop(run_id)
        raise CommitRefused(kind, message, numbers)

    def _log(self, run_id: str, terminal: str, numbers: dict[str, int], kind: str | None = None, message: str = "the run was published") -> None:
        log = RunLog(self.spark, self.log_folder, run_id, getattr(self.target, "path", "") or "")
        log.stage("COMMITTING")
        fields = {k: numbers[k] for k in ("source_rows", "staged_rows", "sink_reported_rows")}
        if kind is not None:
            log.add("commit_diagnosed", terminal="DISCARDED")
            fields |= {"failure_kind": kind, "sink_code": SINK_CODES.get(kind, kind)}
        log.finish(terminal, message=message, **fields)

    def _drop(self, run_id: str) -> bool:
        dropped = False
        for part in ("rows", "ledger"):
            dropped = remove(self.spark, f"{self.staging_path}/{part}/run_id={run_id}") or dropped
        return dropped
