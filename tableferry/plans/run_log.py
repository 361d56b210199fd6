"""The log of one copy run: a handful of lines from the driver, many from the executors.

Every write goes to its own numbered folder, so the lines keep their order by file path.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.operators.numbering import running_total
from tableferry.sources import runlog


def utc_text() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class RunLog:
    """Collects log lines; without a folder it keeps nothing."""

    def __init__(self, spark: SparkSession, folder: str | None, run_id: str, task: str):
        self.spark, self.run_id, self.task = spark, run_id, task
        self.path = None if folder is None else runlog.record_path(folder, run_id)
        self.current_stage = "PREPARING"
        self.lines: list[str] = []
        self.writes = 0

    def add(self, event: str, **fields) -> None:
        level = "error" if fields.get("terminal") == "FAILED" else "info"
        line = {"ts": utc_text(), "level": level, "event": event, "run_id": self.run_id, "task": self.task}
        self.lines.append(json.dumps({**line, **fields}, ensure_ascii=False))

    def stage(self, stage: str) -> None:
        self.current_stage = stage
        self.add("stage_changed", stage=stage)

    def finish(self, terminal: str, **fields) -> None:
        self.add("run_finished", terminal=terminal, stage=self.current_stage, **fields)
        self.flush()

    def issues(self, issues: DataFrame) -> None:
        """All mapping issues, however many."""
        names = {"column_name": "column", "detail": "message"}
        kept = ("column_name", "source", "target", "rule", "detail", "suggestion")
        found = [F.col(c).alias(names.get(c, c)) for c in kept if c in issues.columns]
        self._write_rows("mapping_precheck_failed", issues.select(*found))

    def batches(self, staged: DataFrame) -> None:
        """One line per batch with its payload bytes and the rows sent so far."""
        frame = F.octet_length(F.concat(F.lit('{"seq":,"rows":[]}'), F.col("batch_no").cast("string")))
        per_batch = (
            staged.groupBy("batch_no")
            .agg(F.count("*").alias("rows"), F.sum("row_bytes").alias("row_bytes"))
            .select(
                F.lit(self.run_id).alias("run"),
                F.col("batch_no").alias("seq"),
                "rows",
                (F.col("row_bytes") + F.col("rows") - 1 + frame).alias("bytes"),
                F.col("rows").alias("written"),
            )
        )
        sent = running_total(per_batch, ["run"], "seq", "rows", "source_rows").drop("run")
        # In order over all files: a reader takes the last line's number for the last batch.
        self._write_rows("batch_pushed", sent.orderBy("seq"))

    def flush(self) -> None:
        if self.path is None or not self.lines:
            return
        rows = [(line,) for line in self.lines]
        self.spark.createDataFrame(rows, "value string").coalesce(1).write.text(self._next_folder())
        self.lines = []

    def _write_rows(self, event: str, rows: DataFrame) -> None:
        if self.path is None:
            return
        self.flush()
        common = {
            "ts": F.lit(utc_text()),
            "level": F.lit("info"),
            "event": F.lit(event),
            "run_id": F.lit(self.run_id),
            "task": F.lit(self.task),
        }
        runlog.write_log(rows.withColumns(common), self._next_folder())

    def _next_folder(self) -> str:
        self.writes += 1
        return f"{self.path}/part={self.writes:06d}"
