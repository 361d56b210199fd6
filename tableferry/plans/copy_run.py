"""One copy run: audit, stage, check, gate, publish.

Nothing moves before the audit is clean. The mapped names are resolved against the target without regard
to case, and every column whose type differs from the target's is checked for values that the cast would
refuse or change. The source is read once, by the staging job (and before it when bare NUMBER columns need
their range check, or when an order needs its ranges). Everything after that looks at the
staged rows, so what was checked is exactly what is published.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.operators import upsert as merge
from tableferry.operators.range_audit import CellRule, RangeCheck, range_audit, reject_rows
from tableferry.operators.verify import batch_contiguity, verify_gate
from tableferry.plans.run_log import RunLog
from tableferry.sources import staging
from tableferry.sources.manifest import ManifestTarget
from tableferry.sources.publish import BucketedTarget, FolderTarget
from tableferry.spec import OrderTerm, TaskSpec, apply_spec, order_columns


# The sink's code for a failure kind, where the two differ.
SINK_CODES = {"TARGET_BUSY": "SWAP_TARGET_BUSY"}


class CopyRefused(RuntimeError):
    """The run stopped before the target changed; `kind` says why.

    `details` are the first rows of what was refused. All of it, `found` rows, lies as Parquet under `path`
    when it came from a table.
    """

    def __init__(self, kind: str, message: str, details: Sequence = (), path: str | None = None, found: int | None = None):
        self.kind, self.details, self.path = kind, list(details), path
        self.found = len(self.details) if found is None else found
        super().__init__(f"{kind}: {message}" + (f" ({self.found} in {path})" if path else ""))


@dataclass(frozen=True)
class CopyResult:
    run_id: str
    source_rows: int
    staged_rows: int
    inserted: int
    updated: int
    unchanged: int
    kept: int
    affected: int


@dataclass(frozen=True)
class CopyPlan:
    """A task bound to its target table.

    ``checks`` are the bare NUMBER columns of the audit's range plan; ``rules`` refuse cells the
    target would reject or change. ``on_duplicate`` is ``fail`` or ``latest`` (the later row in
    the task's order wins). ``numbered`` stages the rows in numbered batches and gates on them.
    ``log_folder`` receives the run's log lines (`sources.runlog`). What a run refuses is written under
    ``<staging_path>_refused/run_id=<run>``.
    """

    spec: TaskSpec
    target: FolderTarget | BucketedTarget | ManifestTarget
    staging_path: str
    checks: Sequence[RangeCheck] = field(default=())
    rules: Sequence[CellRule] = field(default=())
    defaults: Mapping[str, object] = field(default_factory=dict)
    collation: str | None = None
    on_duplicate: str = "fail"
    numbered: bool = False
    log_folder: str | None = None


def new_run_id(now: datetime | None = None) -> str:
    now = now or datetime.now(timezone.utc)
    return f"{now:%Y%m%d%H%M%S}_{uuid.uuid4().hex[:6]}"


def refuse_if(issues: DataFrame, kind: str, message: str, path: str, shown: int = 20) -> None:
    """Stop the run when there is any issue: all are written to `path`, the error carries the first few."""
    some = issues.limit(shown).collect()
    if some:
        issues.write.mode("overwrite").parquet(path)
        found = issues.sparkSession.read.schema(issues.schema).parquet(path).count()
        raise CopyRefused(kind, message, some, path, found)


def refused_path(plan: CopyPlan, run_id: str, what: str) -> str:
    return f"{plan.staging_path}_refused/run_id={run_id}/{what}"


def resolved_names(rows: DataFrame, plan: CopyPlan) -> dict[str, str]:
    """The target's spelling of each mapped column; refuses columns that the target lacks or that meet in one."""
    spelled = {f.name.upper(): f.name for f in plan.target.schema.fields}
    wrong = [(c, "TARGET_MISSING") for c in rows.columns if c.upper() not in spelled]
    upper = [c.upper() for c in rows.columns]
    wrong += [(c, "TARGET_REPEATED") for c in rows.columns if upper.count(c.upper()) > 1]
    if wrong:
        raise CopyRefused("MAPPING_PRECHECK", "mapped columns don't fit the target: " + ", ".join(c for c, _ in wrong), wrong)
    return {c: spelled[c.upper()] for c in rows.columns}


def cast_rules(rows: DataFrame, target: T.StructType) -> list[CellRule]:
    """A rule for each column that would be cast: its values must pass the cast and come back unchanged."""
    rules = []
    for field_ in rows.schema.fields:
        kind = target[field_.name].dataType
        if field_.dataType == kind or isinstance(kind, T.StringType):
            continue
        value = F.col(f"`{field_.name}`")
        cast = value.try_cast(kind)
        if isinstance(field_.dataType, T.StringType):
            # A text may spell a number with zeros at its end; what counts is the number.
            same = value.try_cast("decimal(38,18)") == cast.try_cast("decimal(38,18)") if isinstance(kind, T.DecimalType) else F.lit(True)
        else:
            same = cast.try_cast(field_.dataType) == value
        reason = F.when(cast.isNull(), "OUT_OF_RANGE").when(~F.coalesce(same, F.lit(False)), "WOULD_ROUND")
        rules.append(CellRule(field_.name, reason, value.cast("string")))
    return rules


def all_rules(given: Sequence[CellRule], casts: Sequence[CellRule]) -> list[CellRule]:
    """The given rules and those of the casts, which no given rule replaces; a cell is refused once, for a column's first reason."""
    merged: dict[str, CellRule] = {}
    for rule in [*given, *casts]:
        first = merged.get(rule.column)
        merged[rule.column] = rule if first is None else CellRule(rule.column, F.coalesce(first.reason, rule.reason), first.shown)
    return list(merged.values())


def run_copy(
    spark: SparkSession,
    plan: CopyPlan,
    source: DataFrame,
    params: Mapping[str, str] | None = None,
    issues: DataFrame | None = None,
    run_id: str | None = None,
) -> CopyResult:
    """Copy the task's rows from `source` into the target of the plan.

    ``issues`` is the task's mapping audit (`operators.mapping_audit`). A rerun with the same
    rows gives the same target; a failed run leaves the target as it was.
    """
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        raise ValueError("a copy run needs spark.sql.ansi.enabled: without it overflow is NULL and small decimals get an exponent")
    if plan.collation is not None and isinstance(plan.target, ManifestTarget):
        raise ValueError("the buckets of a manifest hold keys byte by byte; use another target for collated keys")
    run_id = run_id or new_run_id()
    log = RunLog(spark, plan.log_folder, run_id, plan.spec.target_table)
    log.add("source_started", message="the run started")
    log.stage("PREPARING")
    try:
        result = _move(spark, plan, source, params, issues, run_id, log)
    except BaseException as error:
        kind = getattr(error, "kind", "UNKNOWN")
        text = str(error).splitlines() or [type(error).__name__]
        # The pointer tells whether this run's version was switched to.
        swapped = plan.target.current(spark) == run_id
        log.add("commit_diagnosed", terminal="SWAPPED" if swapped else "DISCARDED")
        fields = {"sink_code": SINK_CODES.get(kind, kind)} if log.current_stage == "COMMITTING" and kind != "UNKNOWN" else {}
        log.finish("FAILED", message=text[0], failure_kind=kind, **fields)
        raise
    log.stage("SUCCEEDED")
    log.finish(
        "SUCCEEDED",
        message="the run completed",
        source_rows=result.source_rows,
        staged_rows=result.staged_rows,
        sink_reported_rows=result.staged_rows,
        purged_rows=0,
    )
    return result


def _move(spark, plan: CopyPlan, source, params, issues, run_id, log: RunLog) -> CopyResult:
    if issues is not None:
        log.issues(issues)
        refuse_if(issues, "MAPPING_PRECHECK", "the mapping audit found issues", refused_path(plan, run_id, "issues"))
    rows = apply_spec(source, plan.spec, params)
    names = resolved_names(rows, plan)
    rows = rows.withColumnsRenamed({c: n for c, n in names.items() if c != n})
    columns = rows.columns
    upper = {c.upper(): c for c in columns}
    _check_ranges(rows, plan, log)
    key = [upper.get(k.upper(), k) for k in plan.spec.primary_key]
    try:
        log.add("run_opened", staging_table=f"{plan.spec.target_table}__stg_{run_id}", columns_checked=len(columns))
        log.stage("STREAMING")
        if plan.numbered:
            order = order_columns(_target_order(plan.spec, names))
            sent, staged = staging.stage_batches(rows, plan.staging_path, run_id, order)
            log.batches(staged)
            received = _gate_batches(staged, sent.batches, run_id, plan)
            staged = staged.select(*columns)
        else:
            sent, received = staging.stage_run(rows, plan.staging_path, run_id), 0
            staged = staging.read_run(spark, plan.staging_path, run_id, rows.schema)
        # The source may have changed since its range check; the staged rows no longer can.
        _check_ranges(staged, plan, log)
        rules = all_rules(plan.rules, cast_rules(staged, plan.target.schema))
        if rules:
            refused = reject_rows(staged, key, rules)
            refuse_if(refused, "SOURCE_VALUE", "values the target would reject or change", refused_path(plan, run_id, "cells"))
        log.stage("COMMITTING")
        keyed = merge.collate_key(staged, key, plan.collation)
        report = merge.key_report(keyed, key).first()
        _gate(sent, received, report, plan, keyed, key, run_id)
        if report["duplicated_keys"]:
            staged = merge.keep_latest(keyed, key, _target_order(plan.spec, names)).to(staged.schema)
        return _publish(spark, plan, staged, key, run_id, sent.rows, report)
    finally:
        staging.drop_run(spark, plan.staging_path, run_id)


def _gate_batches(staged: DataFrame, sent: int, run_id: str, plan: CopyPlan) -> int:
    """The staged batch numbers must be exactly 1..N, N counted while the batches were cut; returns how many there are."""
    numbers = staged.select(F.lit(run_id).alias("run_id"), "batch_no")
    expected = staged.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(sent).cast("bigint").alias("source_batches"))
    found = batch_contiguity(numbers, expected)
    refuse_if(found.filter(~F.col("contiguous")), "VERIFY_FAILED", "batch numbers are missing", refused_path(plan, run_id, "batches"))
    return sent


def _check_ranges(rows: DataFrame, plan: CopyPlan, log: RunLog) -> None:
    if not plan.checks:
        return
    found = range_audit(rows, plan.checks).collect()
    log.add("range_check_executed", message=f"{found[0]['scanned_rows']} rows scanned")
    bad = [row for row in found if row["invalid_rows"]]
    if bad:
        raise CopyRefused("MAPPING_PRECHECK", "values do not fit the declared decimal", bad)


def _target_order(spec: TaskSpec, spelled: Mapping[str, str]) -> list[OrderTerm]:
    """The task's order under target names; terms on columns that were not copied drop out."""
    names = {c.source.upper(): spelled[c.target] for c in spec.columns}
    return [
        OrderTerm(names[t.column.upper()], t.direction)
        for t in spec.order_by
        if t.column.upper() in names
    ]


def _gate(sent: staging.Sent, received: int, report, plan: CopyPlan, staged: DataFrame, key: list[str], run_id: str) -> None:
    numbers = {
        "source_rows": sent.rows, "source_batches": sent.batches, "staged_rows": report["rows"],
        "sink_reported_rows": sent.written, "received_batches": received,
    }
    counts = staged.sparkSession.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in numbers.items()])
    judged = verify_gate(counts).first()
    if judged["verdict"] != "PASSED":
        text = ", ".join(f"{name} {n}" for name, n in numbers.items())
        raise CopyRefused("VERIFY_FAILED", f"{judged['cause']}: {text}", [judged])
    if report["null_key_rows"]:
        raise CopyRefused("DATA_REJECTED", f"{report['null_key_rows']} rows have a NULL key")
    if report["duplicated_keys"] and plan.on_duplicate == "fail":
        repeated = merge.duplicate_keys(staged, key)
        refuse_if(repeated, "DATA_REJECTED", f"{report['duplicated_keys']} keys are repeated", refused_path(plan, run_id, "keys"))


def _publish(spark, plan: CopyPlan, staged, key, run_id, read, report) -> CopyResult:
    based_on = plan.target.current(spark)
    old, untouched = plan.target.affected(spark, staged, based_on)
    if untouched and not report["rows"]:
        plan.target.publish(old, run_id, None, based_on)
        return CopyResult(run_id, read, 0, 0, 0, 0, untouched, 0)
    merged = merge.upsert(old, staged, key, plan.defaults, plan.collation, plan.target.keeps_buckets)
    effects = Observation()
    names = ("inserted", "updated", "unchanged", "kept")
    counted = merged.observe(
        effects, *[F.count_if(F.col("_effect") == e).alias(e) for e in names]
    ).drop("_effect")

    def check() -> None:
        n = effects.get
        moved = n["inserted"] + n["updated"] + n["unchanged"]
        if moved != report["distinct_keys"]:
            raise CopyRefused("VERIFY_FAILED", f"{report['distinct_keys']} keys staged but {moved} merged")

    plan.target.publish(counted, run_id, check, based_on)
    n = effects.get
    affected = n["inserted"] + 2 * n["updated"] + n["unchanged"]
    counts = {e: n[e] + (untouched if e == "kept" else 0) for e in names}
    return CopyResult(run_id, read, report["rows"], **counts, affected=affected)
