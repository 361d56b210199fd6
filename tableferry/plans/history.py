"""Run history: fold log lines into one row per run, and the reports on top of it.

A log line is one row ``run_record_id, pos, ts, event, run_id`` plus the event fields below;
``pos`` is anything that orders the lines of a record (a number or a file position).

The fold has two steps. The first groups by (record, line run id) and is a plain aggregation,
so a record that owns most lines is combined on the map side and a stream can keep it as state.
The second combines the few states of a record: the first non-null run id owns the record and
lines of other run ids are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Events that end a run before it starts moving data.
CONFIG_FAILURES = (
    "business_date_invalid",
    "source_config_failed",
    "task_config_failed",
    "sql_shape_precheck_failed",
)
# Fields of the terminal line.
TERMINAL_NUMBERS = (
    "source_rows", "staged_rows", "sink_reported_rows", "purged_rows", "source_batches",
    "received_batches", "fetch_ms", "push_ms", "commit_ms", "count_ms", "cursor_ms",
)
TERMINAL_TEXTS = ("source_code", "sink_code", "column", "value", "message", "failure_kind")
# Stages a live run can show.
LIVE_STAGES = ("PREPARING", "STREAMING", "COMMITTING")
# Why a run has no terminal line.
UNKNOWN_REASONS = {
    "PROCESS_DISAPPEARED": "the process disappeared without a terminal log line",
    "SERVICE_RESTARTED": "the service restarted, the outcome is unknown",
}

LOG_FIELDS = (
    "ts string, level string, event string, run_id string, task string, stage string, "
    "staging_table string, terminal string, message string, value string, `column` string, "
    "source string, target string, rule string, suggestion string, failure_kind string, "
    "source_code string, sink_code string, seq bigint, rows bigint, bytes bigint, ms bigint, "
    "written bigint, source_rows bigint, staged_rows bigint, sink_reported_rows bigint, "
    "purged_rows bigint, source_batches bigint, received_batches bigint, fetch_ms bigint, "
    "push_ms bigint, commit_ms bigint, count_ms bigint, cursor_ms bigint"
)


def _last(when: Column, *fields: str) -> Column:
    """Fields of the last line that meets the condition, as STRUCT<pos, fields...>."""
    return F.max(F.when(when, F.struct("pos", *fields)))


def _terminal_effect() -> Column:
    """What a terminal line itself says about the target table."""
    succeeded, failed = F.col("terminal") == "SUCCEEDED", F.col("terminal") == "FAILED"
    return (
        F.when(succeeded, "SWAPPED")
        .when(failed & (F.col("sink_code") == "VERIFY_FAILED"), "DISCARDED")
        .when(failed & (F.col("stage") == "COMMITTING"), "UNKNOWN")
        .when(failed, "DISCARDED")
    )


def fold_states(lines: DataFrame) -> DataFrame:
    """First step: one state row per (run_record_id, run_id)."""
    event = F.col("event")
    finished, pushed = event == "run_finished", event == "batch_pushed"
    config, diagnosed = event.isin(*CONFIG_FAILURES), event == "commit_diagnosed"
    told = (
        F.when(config, "DISCARDED")
        .when(F.col("terminal").isin("SWAPPED", "DISCARDED"), F.col("terminal"))
        .otherwise("UNKNOWN")
    )
    rows = lines.withColumn("_told", told).withColumn("_effect", _terminal_effect())
    return rows.groupBy("run_record_id", "run_id").agg(
        F.min("pos").alias("first_pos"),
        _last(F.col("ts").isNotNull(), "ts").alias("last_line"),
        _last((event == "source_started") & F.col("ts").isNotNull(), "ts").alias("started"),
        _last((event == "stage_changed") | finished, "stage").alias("staged"),
        _last(event == "run_opened", "staging_table").alias("opened"),
        _last(pushed & F.col("seq").isNotNull(), "seq").alias("pushed"),
        F.coalesce(F.sum(F.when(pushed, F.col("rows"))), F.lit(0)).alias("rows_pushed"),
        F.coalesce(F.sum(F.when(pushed, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(pushed, F.col("ms"))), F.lit(0)).alias("ms"),
        F.count_if(event == "mapping_precheck_failed").alias("mapping_issue_count"),
        _last(diagnosed | config, "_told").alias("told"),
        F.min(F.when(finished & F.col("_effect").isNotNull(), F.struct("pos", "_effect"))).alias("implied"),
        _last(finished, "ts", "terminal", *TERMINAL_NUMBERS, *TERMINAL_TEXTS).alias("finished"),
        _last(config, "ts", "message", "value", "failure_kind").alias("refused"),
    )


#: What a fold state keeps of the last line of each kind, each with its `pos`.
FOLD_MEMBERS = ("last_line", "started", "staged", "opened", "pushed", "told", "finished", "refused")
_SUMS = ("rows_pushed", "bytes", "ms", "mapping_issue_count")


def _merged() -> list[Column]:
    return [
        *[F.max(c).alias(c) for c in FOLD_MEMBERS],
        F.min("implied").alias("implied"),
        *[F.sum(c).alias(c) for c in _SUMS],
    ]


def merge_states(states: DataFrame, *keys: str, last: Sequence[str] = ()) -> DataFrame:
    """States of parts of a log, each line in one part, merged into those of the whole, apart by ``keys``.

    Of the columns ``last`` the greatest value stays.
    """
    return states.groupBy("run_record_id", "run_id", *keys).agg(
        F.min("first_pos").alias("first_pos"), *_merged(), *[F.max(c).alias(c) for c in last]
    )


def owning_run_ids(states: DataFrame) -> DataFrame:
    """The first non-null run id of every record."""
    named = F.when(F.col("run_id").isNotNull(), F.struct("first_pos", F.col("run_id").alias("r")))
    return states.groupBy("run_record_id").agg(F.min(named)["r"].alias("owner_run_id"))


def combine_states(states: DataFrame) -> DataFrame:
    """Second step: one folded row per record."""
    accepted = states.join(owning_run_ids(states), "run_record_id").filter(
        F.col("run_id").isNull() | (F.col("run_id") == F.col("owner_run_id"))
    )
    folded = accepted.groupBy("run_record_id", F.col("owner_run_id").alias("run_id")).agg(*_merged())
    fin, ref = F.col("finished"), F.col("refused")
    by_config = ref.isNotNull() & (fin.isNull() | (ref["pos"] > fin["pos"]))
    shared = {"message", "value", "failure_kind"}
    return folded.select(
        "run_record_id",
        "run_id",
        F.col("opened.staging_table").alias("staging_table"),
        F.col("started.ts").alias("logged_start"),
        F.when(by_config, ref["ts"]).otherwise(fin["ts"]).alias("finished_at"),
        F.when(by_config, "FAILED").otherwise(fin["terminal"]).alias("outcome"),
        F.coalesce(F.col("told._told"), F.col("implied._effect")).alias("target_table_effect"),
        F.col("staged.stage").alias("stage"),
        *[fin[c].alias(c) for c in TERMINAL_NUMBERS],
        *[
            (F.when(by_config, ref[c]).otherwise(fin[c]) if c in shared else fin[c]).alias(c)
            for c in TERMINAL_TEXTS
        ],
        F.coalesce(F.col("pushed.seq"), F.lit(0)).alias("seq"),
        *_SUMS,
        F.col("last_line.ts").alias("last_ts"),
    )


def run_history(lines: DataFrame, accepted: DataFrame) -> DataFrame:
    """One history row per accepted run.

    ``accepted``: run_record_id, task_id, run_params MAP<STRING,STRING>, source_text,
    accepted_at STRING. Runs without any log line stay, open and with zero totals. The issues
    themselves are in `mapping_issue_lines`, so a run with very many stays one small row.
    """
    return join_accepted(accepted, combine_states(fold_states(lines)))


def join_accepted(accepted: DataFrame, folded: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("seq", *_SUMS)}
    return accepted.join(folded, "run_record_id", "left").select(
        "run_record_id",
        "run_id",
        "task_id",
        "run_params",
        "source_text",
        "staging_table",
        F.coalesce("logged_start", "accepted_at").alias("started_at"),
        "finished_at",
        "outcome",
        "target_table_effect",
        "stage",
        *TERMINAL_NUMBERS,
        *TERMINAL_TEXTS,
        F.lit(None).cast("string").alias("unknown_reason"),
        *zero.values(),
        "last_ts",
    )


def mapping_issue_lines(lines: DataFrame) -> DataFrame:
    """The mapping issues of every record in line order: ``run_record_id, pos, column, ...``."""
    issues = lines.filter(F.col("event") == "mapping_precheck_failed")
    owners = owning_run_ids(lines.groupBy("run_record_id", "run_id").agg(F.min("pos").alias("first_pos")))
    return (
        issues.join(owners, "run_record_id")
        .filter(F.col("run_id").isNull() | (F.col("run_id") == F.col("owner_run_id")))
        .select("run_record_id", "pos", "column", "source", "target", "rule", "message", "suggestion")
    )


def seal_open_runs(history: DataFrame, reason: str, now: str) -> DataFrame:
    """Close runs without a terminal line: FAILED, effect and details cleared, kind UNKNOWN."""
    open_run = F.col("outcome").isNull()
    cleared = {c: F.lit(None) for c in ("target_table_effect", "source_code", "sink_code", "column", "value")}
    fixed = {
        "outcome": F.lit("FAILED"),
        "finished_at": F.lit(now),
        "message": F.lit(UNKNOWN_REASONS[reason]),
        "unknown_reason": F.lit(reason),
        "failure_kind": F.lit("UNKNOWN"),
    }
    new = {**cleared, **fixed}
    return history.select(
        *[
            F.when(open_run, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`")
            for c in history.columns
        ]
    )


def start_moment(started_at: Column | str = "started_at") -> Column:
    """A history time text (`2026-08-15T10:00:00.000Z`) as UTC timestamp_ntz."""
    text = F.col(started_at) if isinstance(started_at, str) else started_at
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")


def retain(history: DataFrame, now: str, days: int) -> DataFrame:
    """Rows that started no earlier than `days` before `now` (`YYYY-MM-DD HH:MM:SS`, UTC)."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return history.filter(~(start_moment() < cutoff))


def newest_first(history: DataFrame, task_id: str | None = None) -> DataFrame:
    """The history list, optionally of one task."""
    if task_id is not None:
        history = history.filter(F.col("task_id") == task_id)
    return history.orderBy(start_moment().desc_nulls_last(), F.col("run_record_id").desc())


def with_run_state(history: DataFrame) -> DataFrame:
    """Add ``run_state`` (unknown, live, succeeded, failed), ``run_view`` and ``shown_effect``.

    The effect on the target is only shown once a staging table existed.
    """
    state = (
        F.when(F.col("unknown_reason").isNotNull(), "unknown")
        .when(F.col("outcome").isNull(), "live")
        .when(F.col("outcome") == "SUCCEEDED", "succeeded")
        .otherwise("failed")
    )
    prechecked = F.col("sink_code").eqNullSafe("PRECHECK_FAILED")
    view = (
        F.when(F.col("run_state") == "unknown", "unknown")
        .when((F.col("run_state") == "live") & F.col("stage").isin(*LIVE_STAGES), "live")
        .when(F.col("run_state") == "live", "accepted")
        .when(prechecked, "mapping-failed")
        .otherwise(F.col("run_state"))
    )
    staged = F.col("run_id").isNotNull() & F.col("staging_table").isNotNull() & ~prechecked
    known = F.col("target_table_effect").isin("SWAPPED", "DISCARDED")
    shown = F.when(
        F.col("unknown_reason").isNull() & staged & known, F.col("target_table_effect")
    )
    return (
        history.withColumn("run_state", state).withColumn("run_view", view).withColumn("shown_effect", shown)
    )


def with_task(history: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with their task; a run whose task was deleted stays, with ``task_deleted``."""
    known = tasks.select("task_id", "task_name", F.lit(True).alias("_known"))
    return (
        history.join(known, "task_id", "left")
        .withColumn("task_deleted", F.col("_known").isNull())
        .drop("_known")
    )


def rerun_candidates(history: DataFrame, tasks: DataFrame) -> DataFrame:
    """Failed and unknown runs: ``enabled`` when the task still exists, else with the reason."""
    rows = with_task(with_run_state(history), tasks).filter(F.col("run_state").isin("failed", "unknown"))
    return rows.select(
        "run_record_id",
        "task_id",
        "run_params",
        "run_state",
        (~F.col("task_deleted")).alias("enabled"),
        F.when(F.col("task_deleted"), "the task was deleted").alias("reason"),
    )


def live_totals(history: DataFrame) -> DataFrame:
    """What open runs have moved so far."""
    return history.filter(F.col("outcome").isNull()).select(
        "run_record_id", "run_id", "stage", "seq", "rows_pushed", "ms", "bytes", "last_ts"
    )


def params_text(params: Column) -> Column:
    """Canonical text of a parameter map: entries by name, independent of insertion order."""
    return F.to_json(F.array_sort(F.map_entries(params)))


def overlapping_runs(history: DataFrame) -> DataFrame:
    """Open runs of one task with the same parameters: ``task_id, params, open_runs, ...``."""
    return (
        history.filter(F.col("outcome").isNull())
        .groupBy("task_id", params_text(F.col("run_params")).alias("params"))
        .agg(
            F.count("*").alias("open_runs"),
            F.min("run_record_id").alias("first_record"),
            F.max("run_record_id").alias("last_record"),
        )
        .filter("open_runs > 1")
    )


def order_statistic(
    values: DataFrame, group: list[str], value: str, name: str, width: int = 4096
) -> DataFrame:
    """Element floor(n/2) (from 0) of each group's sorted values, exactly and without lists.

    Values are counted map-side, first found to a bucket of `width` values, then inside it, so
    a group that owns most rows costs one task at most `width` counters per bucket.
    """
    from pyspark.sql import Window

    counts = (
        values.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_bucket", F.floor(F.col("_v") / width).cast("bigint"))
    )
    buckets = counts.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_n"))
    up_to = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        buckets.withColumn("_end", F.sum("_n").over(up_to))
        .withColumn("_rank", F.floor(F.sum("_n").over(Window.partitionBy(*group)) / 2).cast("bigint"))
        .filter((F.col("_end") > F.col("_rank")) & (F.col("_end") - F.col("_n") <= F.col("_rank")))
        .select(*group, "_bucket", (F.col("_rank") - F.col("_end") + F.col("_n")).alias("_rank"))
    )
    inside = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(found, [*group, "_bucket"])
        .withColumn("_end", F.sum("_n").over(inside))
        .filter((F.col("_end") > F.col("_rank")) & (F.col("_end") - F.col("_n") <= F.col("_rank")))
        .select(*group, F.col("_v").alias(name))
    )


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left")


def run_measures(lines: DataFrame) -> DataFrame:
    """Per log: the last terminal's numbers, push share of the cursor time, batch distribution."""
    pushed = F.col("event") == "batch_pushed"
    names = ("source_rows", "source_batches", "fetch_ms", "push_ms", "cursor_ms", "commit_ms", "count_ms", "purged_rows")
    summary = lines.groupBy("run_record_id").agg(
        _last(F.col("event") == "run_finished", *names).alias("f"),
        F.min(F.when(pushed, F.col("rows"))).alias("rows_min"),
        F.max(F.when(pushed, F.col("rows"))).alias("rows_max"),
        F.min(F.when(pushed, F.col("bytes"))).alias("bytes_min"),
        F.max(F.when(pushed, F.col("bytes"))).alias("bytes_max"),
    )
    middle = order_statistic(lines.filter(pushed), ["run_record_id"], "bytes", "bytes_p50")
    f = F.col("f")
    share = F.when(
        f["push_ms"].isNotNull() & (f["cursor_ms"] != 0),
        (F.floor(f["push_ms"] * 10000 / f["cursor_ms"]) / 100).cast("decimal(18,2)"),
    )
    return reduce(lambda l, r: _join_on(l, r, ["run_record_id"]), [summary, middle]).select(
        "run_record_id",
        *[f[n].alias(n) for n in names],
        share.alias("push_percent"),
        "rows_min",
        "rows_max",
        "bytes_min",
        "bytes_p50",
        "bytes_max",
    )


def payload_accounting(lines: DataFrame) -> DataFrame:
    """Per log: rows, batches, bytes per row, median batch and MiB moved; NULL without rows."""
    pushed = lines.filter(F.col("event") == "batch_pushed")
    sums = lines.groupBy("run_record_id").agg(
        F.coalesce(F.sum(F.when(F.col("event") == "batch_pushed", F.col("rows"))), F.lit(0)).alias("rows"),
        F.count_if(F.col("event") == "batch_pushed").alias("batches"),
        F.coalesce(F.sum(F.when(F.col("event") == "batch_pushed", F.col("bytes"))), F.lit(0)).alias("bytes"),
    )
    middle = order_statistic(pushed, ["run_record_id"], "bytes", "bytes_p50")
    some = (F.col("batches") > 0) & (F.col("rows") > 0)

    def shown(value: Column) -> Column:
        return F.when(some, value)

    return _join_on(sums, middle, ["run_record_id"]).select(
        "run_record_id",
        shown(F.col("rows")).alias("rows"),
        shown(F.col("batches")).alias("batches"),
        shown(F.floor(F.col("bytes") / F.col("rows")).cast("bigint")).alias("bytes_per_row"),
        shown(F.col("bytes_p50")).alias("bytes_p50"),
        shown((F.floor(F.col("bytes") * 100 / 1048576) / 100).cast("decimal(18,2)")).alias("mib"),
    )
