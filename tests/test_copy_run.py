"""Whole runs: publish, rerun, failure, duplicate keys, empty result."""

import os

import pytest
from pyspark.sql import types as T

from tableferry import ColumnMapping, Condition, OrderTerm, TaskSpec
from tableferry.operators import verify
from tableferry.operators.range_audit import RangeCheck, decimal_target_rule
from tableferry.plans.copy_run import CopyPlan, CopyRefused, new_run_id, run_copy
from tableferry.plans import history
from tableferry.sources import publish as pub
from tableferry.sources import runlog, staging

TARGET = T.StructType(
    [
        T.StructField("ROW_ID", T.DecimalType(8, 0)),
        T.StructField("DEST_NAME", T.StringType()),
        T.StructField("DEST_AMOUNT", T.DecimalType(10, 2)),
        T.StructField("AUDIT", T.StringType()),
    ]
)


def spec(**changes):
    parts = dict(
        owner="APP", table="SRC", target_table="TGT", primary_key=("ROW_ID",),
        columns=(ColumnMapping("row_id", "ROW_ID"), ColumnMapping("src_name", "DEST_NAME"), ColumnMapping("src_amount", "DEST_AMOUNT")),
        order_by=(OrderTerm("src_amount"),),
    )
    return TaskSpec(**{**parts, **changes})


@pytest.fixture()
def plan(tmp_path):
    def make(**changes):
        parts = dict(
            spec=spec(), target=pub.FolderTarget(str(tmp_path / "target"), TARGET),
            staging_path=str(tmp_path / "staging"), defaults={"AUDIT": "copied"},
        )
        return CopyPlan(**{**parts, **changes})

    return make


def rows(spark, *data):
    return spark.createDataFrame(list(data), "row_id int, src_name string, src_amount string").selectExpr(
        "CAST(row_id AS DECIMAL(8,0)) AS row_id", "src_name", "CAST(src_amount AS DECIMAL(10,2)) AS src_amount"
    )


BASE = [(1, "a", "1.50"), (2, "b  ", "2.00"), (3, None, None)]


def current(spark, p):
    return {int(r["ROW_ID"]): (r["DEST_NAME"], r["DEST_AMOUNT"], r["AUDIT"]) for r in p.target.read(spark).collect()}


def digest(spark, p):
    return tuple(verify.table_digest(p.target.read(spark)).first())


def test_a_run_needs_ansi_mode(spark, plan):
    p = plan()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            run_copy(spark, p, rows(spark, *BASE))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert p.target.current(spark) is None


def test_first_run_then_rerun(spark, plan):
    p = plan()
    first = run_copy(spark, p, rows(spark, *BASE))
    assert (first.source_rows, first.inserted, first.affected) == (3, 3, 3)
    before = digest(spark, p)
    again = run_copy(spark, p, rows(spark, *BASE))
    assert (again.inserted, again.unchanged, again.updated, again.affected) == (0, 3, 0, 3)
    assert digest(spark, p) == before
    assert {int(r) for r in current(spark, p)} == {1, 2, 3}
    assert current(spark, p)[2][0] == "b  "
    assert staging.staged_runs(spark, p.staging_path) == []


def test_changed_values_land_and_other_rows_stay(spark, plan):
    p = plan()
    run_copy(spark, p, rows(spark, *BASE, (900, "sentinel", "9.00")))
    result = run_copy(spark, p, rows(spark, (1, "changed", "1.50"), (4, "new", "4.00")))
    assert (result.inserted, result.updated, result.unchanged, result.kept, result.affected) == (1, 1, 0, 3, 3)
    assert current(spark, p)[1][0] == "changed" and current(spark, p)[900][0] == "sentinel"


def test_empty_result_is_a_valid_run(spark, plan):
    p = plan()
    run_copy(spark, p, rows(spark, *BASE))
    before = digest(spark, p)
    result = run_copy(spark, p, rows(spark, *BASE).limit(0))
    assert (result.source_rows, result.affected, result.kept) == (0, 0, 3)
    assert digest(spark, p) == before


def test_conditions_of_the_run(spark, plan):
    task = spec(conditions=(Condition("src_name", "eq", "text", "P_NAME", "runtime"),))
    p = plan(spec=task)
    assert run_copy(spark, p, rows(spark, *BASE), {"P_NAME": "a"}).source_rows == 1


@pytest.mark.parametrize(
    "bad, kind",
    [((1, "dup", "7.00"), "DATA_REJECTED"), ((None, "x", "7.00"), "DATA_REJECTED")],
)
def test_key_problems_leave_the_target_alone(spark, plan, bad, kind):
    p = plan()
    run_copy(spark, p, rows(spark, *BASE))
    before, version = digest(spark, p), p.target.current(spark)
    with pytest.raises(CopyRefused) as error:
        run_copy(spark, p, rows(spark, *BASE, bad))
    assert error.value.kind == kind
    assert digest(spark, p) == before and p.target.current(spark) == version
    assert staging.staged_runs(spark, p.staging_path) == []


def test_later_row_wins_on_request(spark, plan):
    p = plan(on_duplicate="latest")
    result = run_copy(spark, p, rows(spark, *BASE, (1, "late", "99.00")))
    assert (result.source_rows, result.inserted) == (4, 3)
    assert current(spark, p)[1][0] == "late"


def test_audit_issues_stop_the_run(spark, plan):
    p = plan()
    issues = spark.createDataFrame([("V", "TEXT_TOO_SHORT")], "column_name string, rule string")
    with pytest.raises(CopyRefused) as error:
        run_copy(spark, p, rows(spark, *BASE), issues=issues)
    assert error.value.kind == "MAPPING_PRECHECK" and len(error.value.details) == 1
    assert not os.path.exists(p.staging_path)


def test_range_check_stops_the_run(spark, plan):
    p = plan(checks=[RangeCheck("DEST_AMOUNT", 3, 2)])
    assert run_copy(spark, p, rows(spark, *BASE)).inserted == 3
    with pytest.raises(CopyRefused):
        run_copy(spark, p, rows(spark, (5, "x", "10.00")))


def test_refused_cells_stop_the_run(spark, plan, tmp_path):
    text = T.StructType([T.StructField("ROW_ID", T.StringType()), T.StructField("DEST_NAME", T.StringType())])
    task = spec(columns=(ColumnMapping("row_id", "ROW_ID"), ColumnMapping("src_name", "DEST_NAME")), order_by=())
    p = plan(spec=task, target=pub.FolderTarget(str(tmp_path / "text"), text), rules=[decimal_target_rule("ROW_ID", 8, 0)], defaults={})
    df = spark.createDataFrame([("1", "a"), ("1.5", "b")], "row_id string, src_name string")
    with pytest.raises(CopyRefused) as error:
        run_copy(spark, p, df)
    assert error.value.kind == "SOURCE_VALUE" and error.value.details[0]["value"] == "1.5"
    assert p.target.current(spark) is None and staging.staged_runs(spark, p.staging_path) == []


def test_own_rules_do_not_replace_the_cast_guard(spark, plan, tmp_path):
    from pyspark.sql import functions as F

    from tableferry.operators.range_audit import CellRule

    source = spark.createDataFrame([(1, "a", "1.2355"), (2, "b", "-4.00")], "row_id int, src_name string, src_amount string")
    source = source.withColumn("src_amount", F.col("src_amount").cast("decimal(10,4)"))
    negative = CellRule("DEST_AMOUNT", F.when(F.col("DEST_AMOUNT") < 0, "NEGATIVE"), F.col("DEST_AMOUNT").cast("string"))
    p = plan(rules=(negative,), log_folder=str(tmp_path / "log"))
    with pytest.raises(CopyRefused, match="SOURCE_VALUE") as refused:
        run_copy(spark, p, source)
    assert sorted((r["value"], r["reason"]) for r in refused.value.details) == [("-4.0000", "NEGATIVE"), ("1.2355", "WOULD_ROUND")]
    assert p.target.current(spark) is None


def test_a_busy_target_is_logged_as_such(spark, plan, tmp_path):
    p = plan(log_folder=str(tmp_path / "log"))
    run_copy(spark, p, rows(spark, *BASE), run_id="20240102030405_00000a")
    # Another run holds the claim on the version this run starts from.
    pub.create_once(spark, pub._claim(p.target.path, "20240102030405_00000a"), "20240102030405_00000b")
    with pytest.raises(pub.TargetBusy):
        run_copy(spark, p, rows(spark, *BASE), run_id="20240102030405_00000c")
    states = history.combine_states(history.fold_states(runlog.read_log(spark, f"{tmp_path}/log/*/*", runlog.RECORD_FOLDER)))
    failed = states.filter("run_id = '20240102030405_00000c'").select("outcome", "failure_kind", "sink_code").first()
    assert tuple(failed) == ("FAILED", "TARGET_BUSY", "SWAP_TARGET_BUSY")


def test_a_lost_last_batch_fails_the_gate(spark, plan, monkeypatch):
    real = staging.stage_batches

    def losing(*args):
        sent, staged = real(*args)
        return sent._replace(batches=sent.batches + 1), staged

    monkeypatch.setattr(staging, "stage_batches", losing)
    p = plan(numbered=True)
    with pytest.raises(CopyRefused, match="batch numbers are missing"):
        run_copy(spark, p, rows(spark, *BASE))
    assert p.target.current(spark) is None


def test_the_gate_gives_its_five_numbers(spark, plan, monkeypatch):
    real = staging.stage_run
    monkeypatch.setattr(staging, "stage_run", lambda *args: (s := real(*args))._replace(rows=s.rows + 2, written=s.written + 2))
    with pytest.raises(CopyRefused, match="LOST_IN_WRITE: source_rows 5, source_batches 0, staged_rows 3, sink_reported_rows 5, received_batches 0"):
        run_copy(spark, plan(), rows(spark, *BASE))


def test_failed_check_keeps_the_old_version(spark, tmp_path):
    table = str(tmp_path / "t")
    df = spark.range(3)
    pub.publish(df, table, "r1")

    def fail():
        raise RuntimeError("counts differ")

    with pytest.raises(RuntimeError):
        pub.publish(spark.range(9), table, "r2", fail)
    assert pub.current_version(spark, table) == "r1"
    assert pub.read_current(spark, table, df.schema).count() == 3
    assert not os.path.exists(f"{table}/versions/r2")
    with pytest.raises(ValueError):
        pub.publish(df, table, "r1")


def test_previous_version_is_kept_and_older_ones_go(spark, tmp_path):
    table = str(tmp_path / "t")
    for run in ("r1", "r2", "r3"):
        pub.publish(spark.range(3), table, run)
    assert sorted(os.listdir(f"{table}/versions")) == ["r2", "r3"]
    assert [f for f in os.listdir(table) if f.startswith("CURRENT")] == ["CURRENT"]


def test_replacing_a_batch_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "s")
    two = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run_id string, batch_no bigint, v string")
    staging.replace_batches(two, path)
    staging.replace_batches(spark.createDataFrame([("r", 2, "B"), ("r", 2, "C")], two.schema), path)
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("batch_no", "v").collect())
    assert got == [(1, "a"), (2, "B"), (2, "C")]


def test_run_id_form():
    import re

    assert re.fullmatch(r"[0-9]{14}_[0-9a-f]{6}", new_run_id())


@pytest.fixture()
def bucketed(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS ferry_target")
    yield pub.BucketedTarget("ferry_target.goods", TARGET, ("ROW_ID",), 4)
    spark.sql("DROP DATABASE ferry_target CASCADE")


def test_bucketed_target(spark, plan, bucketed):
    p = plan(target=bucketed)
    run_copy(spark, p, rows(spark, *BASE, (900, "sentinel", "9.00")))
    result = run_copy(spark, p, rows(spark, (1, "changed", "1.50"), (4, "new", "4.00")))
    assert (result.inserted, result.updated, result.kept) == (1, 1, 3)
    assert current(spark, p)[1][0] == "changed" and current(spark, p)[900][0] == "sentinel"
    seen = spark.table("ferry_target.goods")
    assert seen.exceptAll(p.target.read(spark)).count() == 0
    run_copy(spark, p, rows(spark, *BASE))
    versions = [t.name for t in spark.catalog.listTables("ferry_target") if "__v_" in t.name]
    assert len(versions) == 2
    with pytest.raises(CopyRefused):
        run_copy(spark, p, rows(spark, *BASE, BASE[0]))
    assert len([t for t in spark.catalog.listTables("ferry_target") if "__v_" in t.name]) == 2


def test_bucketed_target_is_not_shuffled(spark, plan, bucketed):
    from tableferry.operators.upsert import upsert

    run_copy(spark, plan(target=bucketed), rows(spark, *BASE))
    staged = rows(spark, *BASE).toDF("ROW_ID", "DEST_NAME", "DEST_AMOUNT")
    merged = upsert(bucketed.read(spark), staged, ["ROW_ID"])
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in text and text.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in text and "SelectedBucketsCount: 4 out of 4" in text


def test_run_log_becomes_history(spark, plan, tmp_path):
    from tableferry.plans import history
    from tableferry.sources import runlog

    folder = str(tmp_path / "log")
    p = plan(numbered=True, log_folder=folder, spec=spec())
    many = [(i, f"name {i}", "1.00") for i in range(1, 12001)]
    good = run_copy(spark, p, rows(spark, *many))
    issues = spark.createDataFrame([("V", "CHAR(3)", "TEXT", "R1", "d", "s"), ("W", "CLOB", "TEXT", "R2", "d", "s")],
                                   "column_name string, source string, target string, rule string, detail string, suggestion string")
    with pytest.raises(CopyRefused):
        run_copy(spark, p, rows(spark, *BASE), issues=issues, run_id="20240102030405_0000aa")
    with pytest.raises(CopyRefused):
        run_copy(spark, p, rows(spark, *BASE, BASE[0]), run_id="20240102030405_0000bb")
    log = runlog.read_log(spark, f"{folder}/*/*", runlog.RECORD_FOLDER)
    accepted = log.select("run_record_id").distinct().selectExpr("run_record_id", "'t' AS task_id", "map('P', '1') AS run_params", "'' AS source_text", "'2024-01-01T00:00:00.000Z' AS accepted_at")
    got = {r["run_record_id"]: r for r in history.run_history(log, accepted).collect()}
    done = got[good.run_id]
    assert (done["outcome"], done["target_table_effect"], done["stage"]) == ("SUCCEEDED", "SWAPPED", "SUCCEEDED")
    assert (done["source_rows"], done["rows_pushed"], done["run_id"]) == (12000, 12000, good.run_id)
    assert done["staging_table"] == f"TGT__stg_{good.run_id}"
    pushed = log.filter((log.event == "batch_pushed") & (log.run_id == good.run_id)).orderBy("seq").collect()
    assert [r["seq"] for r in pushed] == list(range(1, len(pushed) + 1)) and max(r["rows"] for r in pushed) <= 5000
    audit = got["20240102030405_0000aa"]
    assert (audit["outcome"], audit["mapping_issue_count"], audit["failure_kind"], audit["staging_table"]) == ("FAILED", 2, "MAPPING_PRECHECK", None)
    assert sorted(r["column"] for r in history.mapping_issue_lines(log).collect()) == ["V", "W"]
    repeated = got["20240102030405_0000bb"]
    assert (repeated["failure_kind"], repeated["stage"], repeated["target_table_effect"]) == ("DATA_REJECTED", "COMMITTING", "DISCARDED")


def test_batch_log_bytes_equal_the_payloads(spark, plan, tmp_path):
    from pyspark.sql import functions as F

    from tableferry.operators.numbering import assign_batches, canonical_cells
    from tableferry.plans.run_log import RunLog
    from tableferry.sources import payload, runlog

    df = rows(spark, *[(i, "é" * (i % 50), "1.50") for i in range(300)])
    batched = assign_batches(df, [F.col("row_id")], row_limit=40, byte_budget=1500)
    RunLog(spark, str(tmp_path), "r", "t").batches(batched)
    logged = {r["seq"]: (r["rows"], r["bytes"]) for r in runlog.read_log(spark, f"{tmp_path}/*/*", runlog.RECORD_FOLDER).collect()}
    sent = payload.write_payloads(batched.select("batch_no", "row_no", canonical_cells(df).alias("c")), F.col("c"))
    assert logged == {r["batch_no"]: (r["rows"], r["bytes"]) for r in sent.collect()}


def test_collated_keys(spark, plan, tmp_path):
    """Keys that the target's collation does not tell apart count as one."""
    schema = T.StructType([T.StructField("ROW_ID", T.StringType()), T.StructField("DEST_NAME", T.StringType())])
    task = spec(columns=(ColumnMapping("row_id", "ROW_ID"), ColumnMapping("src_name", "DEST_NAME")), order_by=(OrderTerm("src_name"),))
    df = spark.createDataFrame([("A", "1"), ("a", "2"), ("b", "3")], "row_id string, src_name string")

    def make(name, **changes):
        return plan(spec=task, target=pub.FolderTarget(str(tmp_path / name), schema), defaults={}, **changes)

    assert run_copy(spark, make("plain"), df).inserted == 3
    with pytest.raises(CopyRefused):
        run_copy(spark, make("strict", collation="UNICODE_CI_AI"), df)
    p = make("latest", collation="UNICODE_CI_AI", on_duplicate="latest")
    assert run_copy(spark, p, df).inserted == 2
    again = run_copy(spark, p, df.filter("row_id = 'A'"))
    assert (again.updated, again.kept) == (1, 1)
    assert sorted(tuple(r) for r in p.target.read(spark).collect()) == [("a", "1"), ("b", "3")]


def test_bucketed_versions_have_one_file_per_bucket(spark, plan, tmp_path, bucketed):
    """Small or large, first or later: no task scatters rows over many buckets."""
    p = plan(target=bucketed)
    many = [(i, f"name {i}", "1.00") for i in range(2000)]
    for part in (many, many[:5], many[500:]):
        result = run_copy(spark, p, rows(spark, *part).repartition(7))
        files = spark.table(f"ferry_target.goods__v_{result.run_id}").select("_metadata.file_path").distinct().count()
        assert files <= bucketed.buckets
    assert p.target.read(spark).count() == 2000


def test_names_meet_the_target_in_any_case(spark, plan):
    mapping = (ColumnMapping("row_id", "row_id"), ColumnMapping("src_name", "Dest_Name"), ColumnMapping("src_amount", "dest_amount"))
    p = plan(spec=spec(columns=mapping, primary_key=("row_Id",)))
    run_copy(spark, p, rows(spark, *BASE))
    assert current(spark, p)[2][:2] == ("b  ", 2)
    mapping = (*mapping, ColumnMapping("more", "EXTRA"))
    with pytest.raises(CopyRefused) as error:
        run_copy(spark, plan(spec=spec(columns=mapping)), rows(spark, *BASE).selectExpr("*", "1 AS more"))
    assert error.value.details == [("EXTRA", "TARGET_MISSING")]


def test_a_plain_run_neither_rounds_nor_cuts(spark, plan):
    p = plan()
    df = spark.createDataFrame([(k, "x", f"{k}.235") for k in range(150)] + [(900, "x", "1.5000")], "row_id int, src_name string, src_amount string")
    df = df.withColumn("src_amount", df.src_amount.cast("decimal(12,4)"))
    with pytest.raises(CopyRefused) as error:
        run_copy(spark, p, df)
    assert error.value.kind == "SOURCE_VALUE" and error.value.found == 150 and len(error.value.details) == 20
    assert spark.read.parquet(error.value.path).count() == 150
    with pytest.raises(CopyRefused):
        run_copy(spark, p, df.filter("row_id = 900").selectExpr("row_id + 99999999 AS row_id", "src_name", "src_amount"))
    assert run_copy(spark, p, df.filter("row_id = 900")).inserted == 1


@pytest.mark.parametrize("kind", ["folder", "bucketed"])
def test_overlapping_publishes_lose_nothing(spark, tmp_path, bucketed, kind):
    target = pub.FolderTarget(str(tmp_path / "busy"), TARGET) if kind == "folder" else bucketed
    made = lambda n: spark.createDataFrame([(k, "x", None, None) for k in range(n)], "ROW_ID int, DEST_NAME string, DEST_AMOUNT int, AUDIT string").to(TARGET)
    target.publish(made(1), "r1")
    # Both runs read r1; the other one publishes while this one has written but not switched.
    with pytest.raises(pub.TargetBusy):
        target.publish(made(3), "r3", lambda: target.publish(made(2), "r2", None, "r1"), "r1")
    assert target.current(spark) == "r2" and target.read(spark).count() == 2
    # A run that read r1 before r2 was published comes late.
    with pytest.raises(pub.TargetBusy):
        target.publish(made(4), "r4", None, "r1")
    target.publish(made(5), "r5", None, "r2")
    target.publish(made(6), "r6", None, "r5")
    assert target.current(spark) == "r6" and target.read(spark).count() == 6
