"""Run history fold, states and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tableferry.plans import history
from tableferry.sources import runlog

RUN = "20260302071500_c0ffee"
BATCHES = [(5000, 81_920), (5000, 80_111), (1250, 20_480), (7, 311)]  # rows and bytes


def at(second):
    return f"2026-03-02T07:{15 + second // 60:02d}:{second % 60:02d}.250Z"


def failed_run():
    """The log of a run of four batches, one of which lost rows on its way: its commit is refused."""
    begin = [
        {"event": "source_started", "run_id": None},
        {"event": "stage_changed", "run_id": RUN, "stage": "PREPARING"},
        {"event": "run_opened", "run_id": RUN, "staging_table": f"PRICE_LIST__stg_{RUN}"},
        {"event": "stage_changed", "run_id": RUN, "stage": "STREAMING"},
    ]
    batches = [
        {"event": "batch_pushed", "run_id": RUN, "seq": k, "rows": rows, "bytes": size, "ms": 40 * k}
        for k, (rows, size) in enumerate(BATCHES, start=1)
    ]
    sent = sum(rows for rows, _ in BATCHES)
    end = [
        {"event": "stage_changed", "run_id": RUN, "stage": "COMMITTING"},
        {"event": "commit_diagnosed", "run_id": RUN, "terminal": "UNKNOWN", "message": "no answer yet"},
        {"event": "commit_diagnosed", "run_id": RUN, "terminal": "DISCARDED", "message": "old version is current"},
        {"event": "run_finished", "run_id": RUN, "terminal": "FAILED", "stage": "COMMITTING", "sink_code": "VERIFY_FAILED",
         "source_code": "-", "column": "LIST_PRICE", "value": "19.99", "message": f"{sent - 7} of {sent} rows staged",
         "failure_kind": "VERIFY_FAILED", "source_rows": sent, "staged_rows": sent - 7, "sink_reported_rows": sent, "purged_rows": sent - 7,
         "source_batches": 4, "received_batches": 4, "fetch_ms": 310, "push_ms": 400, "commit_ms": 95, "count_ms": 21, "cursor_ms": 12},
    ]
    return [{"ts": at(11 * k), **line} for k, line in enumerate([*begin, *batches, *end])]


FAILED_COMMIT = failed_run()


def lines(spark, **records):
    rows = [(json.dumps(line), record, pos) for record, log in records.items() for pos, line in enumerate(log)]
    return runlog.parse_log(spark.createDataFrame(rows, "value string, run_record_id string, pos bigint"))


def accepted(spark, *records):
    rows = [(r, "task-1", {"P": "1"}, "FROM T", "2026-08-15T09:59:59.000Z") for r in records]
    return spark.createDataFrame(rows, "run_record_id string, task_id string, run_params map<string,string>, source_text string, accepted_at string")


def folded(spark, log):
    return history.run_history(lines(spark, r=log), accepted(spark, "r")).first()


def finish(**fields):
    return {"ts": "2026-08-15T11:00:00.000Z", "event": "run_finished", "run_id": RUN, **fields}


def test_failed_commit(spark):
    row = folded(spark, FAILED_COMMIT)
    last = FAILED_COMMIT[-1]
    # The terminal line's own fields, sums and the last number over the batches, and what was accepted.
    expected = {k: v for k, v in last.items() if k not in ("ts", "event", "terminal")}
    expected |= {
        "outcome": "FAILED", "target_table_effect": "DISCARDED", "staging_table": f"PRICE_LIST__stg_{RUN}", "seq": len(BATCHES),
        "rows_pushed": sum(r for r, _ in BATCHES), "bytes": sum(b for _, b in BATCHES), "ms": sum(40 * k for k in (1, 2, 3, 4)),
        "mapping_issue_count": 0, "started_at": at(0), "finished_at": last["ts"], "last_ts": last["ts"],
        "task_id": "task-1", "run_params": {"P": "1"}, "source_text": "FROM T", "unknown_reason": None,
    }
    assert {k: row[k] for k in expected} == expected


def test_run_without_lines_stays_open(spark):
    row = history.run_history(lines(spark, other=FAILED_COMMIT), accepted(spark, "r")).first()
    assert (row["outcome"], row["run_id"], row["seq"], row["rows_pushed"], row["started_at"]) == (None, None, 0, 0, "2026-08-15T09:59:59.000Z")


def test_lines_of_another_run_are_ignored(spark):
    log = FAILED_COMMIT[:5] + [{"ts": "2026-08-16T00:00:00.000Z", "event": "batch_pushed", "run_id": "run-8", "seq": 9, "rows": 50, "bytes": 1, "ms": 1}]
    row = folded(spark, log)
    assert (row["run_id"], row["seq"], row["rows_pushed"], row["last_ts"]) == (RUN, 1, 5000, at(44))


@pytest.mark.parametrize(
    "log, effect",
    [
        ([finish(terminal="SUCCEEDED")], "SWAPPED"),
        ([finish(terminal="FAILED", stage="COMMITTING")], "UNKNOWN"),
        ([finish(terminal="FAILED", stage="COMMITTING", sink_code="VERIFY_FAILED")], "DISCARDED"),
        ([finish(terminal="FAILED", stage="STREAMING")], "DISCARDED"),
        ([{"event": "commit_diagnosed", "run_id": RUN, "terminal": None}, finish(terminal="FAILED", stage="STREAMING")], "UNKNOWN"),
        ([{"event": "commit_diagnosed", "run_id": RUN, "terminal": "SWAPPED"}, finish(terminal="FAILED", stage="COMMITTING")], "SWAPPED"),
        ([finish(terminal="SUCCEEDED"), {"event": "commit_diagnosed", "run_id": RUN, "terminal": "DISCARDED"}], "DISCARDED"),
        ([{"event": "source_config_failed", "run_id": None, "message": "bad"}], "DISCARDED"),
        ([finish(terminal=None)], None),
    ],
)
def test_target_effect(spark, log, effect):
    assert folded(spark, log)["target_table_effect"] == effect


def test_config_failure_ends_a_run(spark):
    row = folded(spark, [{"ts": "2026-08-15T10:00:00.000Z", "event": "task_config_failed", "run_id": None, "message": "bad", "value": "v", "failure_kind": "CONFIG"}])
    assert (row["outcome"], row["finished_at"], row["message"], row["value"], row["failure_kind"], row["run_id"]) == (
        "FAILED", "2026-08-15T10:00:00.000Z", "bad", "v", "CONFIG", None)


def test_mapping_issues_keep_their_order(spark):
    issue = {"event": "mapping_precheck_failed", "run_id": RUN}
    log = [{**issue, "column": "LABEL", "rule": "R1", "suggestion": "s"}, {**issue, "column": "VALID_FROM", "rule": "R2"}, {**issue, "run_id": "run-9", "column": "X"}]
    df = lines(spark, r=log)
    got = [(r["column"], r["rule"], r["suggestion"]) for r in history.mapping_issue_lines(df).orderBy("pos").collect()]
    assert got == [("LABEL", "R1", "s"), ("VALID_FROM", "R2", None)]
    assert history.run_history(df, accepted(spark, "r")).first()["mapping_issue_count"] == 2


def test_seal_open_runs(spark):
    h = history.run_history(lines(spark, a=FAILED_COMMIT, b=FAILED_COMMIT[:5]), accepted(spark, "a", "b"))
    rows = {r["run_record_id"]: r for r in history.seal_open_runs(h, "PROCESS_DISAPPEARED", "2026-08-16T00:00:00.000Z").collect()}
    assert rows["a"]["message"] == FAILED_COMMIT[-1]["message"] and rows["a"]["unknown_reason"] is None
    b = rows["b"]
    assert (b["outcome"], b["target_table_effect"], b["failure_kind"], b["unknown_reason"], b["rows_pushed"]) == ("FAILED", None, "UNKNOWN", "PROCESS_DISAPPEARED", 5000)


def test_retention_is_strict(spark):
    starts = ["2026-05-16T23:59:59.999Z", "2026-05-17T00:00:00.000Z", "2026-08-15T00:00:00.000Z"]
    df = spark.createDataFrame([(s,) for s in starts], "started_at string")
    assert sorted(r[0] for r in history.retain(df, "2026-08-15 00:00:00", 90).collect()) == starts[1:]


def test_states_and_reruns(spark):
    logs = dict(
        live=FAILED_COMMIT[:5], accepted=[FAILED_COMMIT[0]], failed=FAILED_COMMIT, done=FAILED_COMMIT[:3] + [finish(terminal="SUCCEEDED", stage="SUCCEEDED")],
        mapping=[finish(terminal="FAILED", stage="PREPARING", sink_code="PRECHECK_FAILED")],
    )
    h = history.run_history(lines(spark, **logs), accepted(spark, *logs))
    got = {r["run_record_id"]: (r["run_state"], r["run_view"], r["shown_effect"]) for r in history.with_run_state(h).collect()}
    assert got == {
        "live": ("live", "live", None), "accepted": ("live", "accepted", None), "failed": ("failed", "failed", "DISCARDED"),
        "done": ("succeeded", "succeeded", "SWAPPED"), "mapping": ("failed", "mapping-failed", None),
    }
    tasks = spark.createDataFrame([("task-1", "T")], "task_id string, task_name string")
    assert {r["run_record_id"]: r["enabled"] for r in history.rerun_candidates(h, tasks).collect()} == {"failed": True, "mapping": True}
    gone = history.rerun_candidates(h, tasks.limit(0)).collect()
    assert {r["reason"] for r in gone} == {"the task was deleted"}
    sealed = history.seal_open_runs(h, "SERVICE_RESTARTED", "2026-08-16T00:00:00.000Z")
    assert {r["run_state"] for r in history.rerun_candidates(sealed, tasks).collect()} == {"failed", "unknown"}
    assert sorted(r["run_record_id"] for r in history.live_totals(h).collect()) == ["accepted", "live"]


def test_newest_first(spark):
    df = spark.createDataFrame([("a", "t1", "2026-01-02T00:00:00.000Z"), ("b", "t1", "2026-01-03T00:00:00.000Z"), ("c", "t2", "2026-01-04T00:00:00.000Z")],
                               "run_record_id string, task_id string, started_at string")
    assert [r[0] for r in history.newest_first(df).collect()] == ["c", "b", "a"]
    assert [r[0] for r in history.newest_first(df, "t1").collect()] == ["b", "a"]


def test_overlap_ignores_parameter_order(spark):
    rows = [("a", "t", {"x": "1", "y": "2"}, None), ("b", "t", {"y": "2", "x": "1"}, None), ("c", "t", {"x": "1"}, None), ("d", "u", {"x": "1"}, None), ("e", "t", {"x": "1"}, "FAILED")]
    df = spark.createDataFrame(rows, "run_record_id string, task_id string, run_params map<string,string>, outcome string")
    got = history.overlapping_runs(df).collect()
    assert [(r["task_id"], r["open_runs"], r["first_record"], r["last_record"]) for r in got] == [("t", 2, "a", "b")]


@pytest.mark.parametrize("width", [1, 16, 4096])
def test_order_statistic_is_exact(spark, width):
    pick = random.Random(11)
    rows = [("hot", pick.randrange(50)) for _ in range(901)] + [("even", v) for v in (5, 1, 9, 7)] + [("one", 3), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    expected = {}
    for g in ("hot", "even", "one"):
        values = sorted(v for name, v in rows if name == g and v is not None)
        expected[g] = values[len(values) // 2]
    got = {r["g"]: r["m"] for r in history.order_statistic(df, ["g"], "v", "m", width).collect()}
    assert got == expected


def test_fold_combines_before_the_shuffle(spark):
    plan = history.fold_states(lines(spark, r=FAILED_COMMIT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_max" in plan


def test_log_files_round_trip(spark, tmp_path):
    """Line order comes from the file; lines that are no JSON object are skipped."""
    folder = tmp_path / "logs"
    folder.mkdir()
    texts = [json.dumps(line) for line in FAILED_COMMIT]
    (folder / "rec-1.jsonl").write_text("\n".join([texts[0], "not json", "[1]", *texts[1:]]) + "\n")
    (folder / "rec-2.jsonl").write_text("\n".join(texts[:5]) + "\n")
    log = runlog.read_log(spark, str(folder))
    rows = {r["run_record_id"]: r for r in history.run_history(log, accepted(spark, "rec-1", "rec-2")).collect()}
    assert (rows["rec-1"]["stage"], rows["rec-1"]["target_table_effect"]) == ("COMMITTING", "DISCARDED")
    assert (rows["rec-2"]["outcome"], rows["rec-2"]["stage"]) == (None, "STREAMING")


def test_split_log_files_keep_their_order(spark, tmp_path):
    stages = [json.dumps({"event": "stage_changed", "run_id": RUN, "stage": f"S{i:05d}", "pad": "x" * 200}) for i in range(4000)]
    (tmp_path / "rec-1.jsonl").write_text("\n".join(stages) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        log = runlog.read_log(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 3
        assert history.run_history(log, accepted(spark, "rec-1")).first()["stage"] == "S03999"
        assert log.select("pos").distinct().count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_lines_hold_absent_fields_as_null(spark, tmp_path):
    events = spark.createDataFrame([("2026-01-01T00:00:00.000Z", "info", "run_opened", "r", "t", None, 5)],
                                   "ts string, level string, event string, run_id string, task string, message string, columns_checked bigint")
    runlog.write_log(events, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert list(json.loads(line).items()) == [
        ("ts", "2026-01-01T00:00:00.000Z"), ("level", "info"), ("event", "run_opened"), ("run_id", "r"), ("task", "t"), ("message", None), ("columns_checked", 5)
    ]


def test_event_set():
    assert len(runlog.EVENTS) == len(set(runlog.EVENTS)) == 18


def test_measures_without_batches(spark):
    df = lines(spark, r=[finish(terminal="FAILED", push_ms=5, cursor_ms=0)])
    row = history.run_measures(df).first()
    assert (row["push_ms"], row["push_percent"], row["bytes_p50"]) == (5, None, None)
    assert tuple(history.payload_accounting(df).first())[1:] == (None,) * 5


def test_fold_equals_a_plain_loop(spark):
    """Random logs, many run ids, one hot record."""
    pick = random.Random(5)
    rows = []
    for pos in range(3000):
        record = "hot" if pos % 3 == 0 else f"r{pick.randrange(20)}"
        run = pick.choice([None, None, "x", "y"])
        rows.append((record, pos, run, pick.choice(["batch_pushed", "stage_changed"]), f"S{pos}", pos, 1))
    df = spark.createDataFrame(rows, "run_record_id string, pos bigint, run_id string, event string, stage string, seq bigint, rows bigint")
    missing = {f.split(" ")[0].strip("`"): f.split(" ")[1] for f in history.LOG_FIELDS.split(", ")}
    df = df.select(*df.columns, *[F.lit(None).cast(t).alias(n) for n, t in missing.items() if n not in df.columns])
    expected = {}
    for record, pos, run, event, stage, seq, n in rows:
        state = expected.setdefault(record, {"run": None, "stage": None, "seq": 0, "rows": 0})
        if run is not None and state["run"] not in (None, run):
            continue
        state["run"] = state["run"] or run
        if event == "stage_changed":
            state["stage"] = stage
        else:
            state["seq"], state["rows"] = seq, state["rows"] + n
    got = {r["run_record_id"]: {"run": r["run_id"], "stage": r["stage"], "seq": r["seq"], "rows": r["rows_pushed"]}
           for r in history.combine_states(history.fold_states(df)).collect()}
    assert got == expected
