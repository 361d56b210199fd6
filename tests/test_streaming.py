"""Batch intake and the live run table."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tableferry.plans import history
from tableferry.streaming import intake, live

RUN, SEALED, UNKNOWN = "20240102030405_00000a", "20240102030405_00000b", "20240102030405_00000c"
COLUMNS = ["id", "v"]


class Box:
    """A small intake: files under incoming/<run>/, run states that a test may change."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.sealed = {RUN: False, SEALED: True}
        self.clock = 1_700_000_000

    def put(self, run, name, *payloads):
        folder = f"{self.root}/incoming/{run}"
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{name}.json"
        with open(path, "w") as out:
            out.write("\n".join(p if isinstance(p, str) else json.dumps(p) for p in payloads) + "\n")
        self.clock += 10
        os.utime(path, (self.clock, self.clock))

    def states(self, session):
        return session.createDataFrame(list(self.sealed.items()), "run_id string, sealed boolean")

    def run(self, max_files=None, checkpoint="checkpoint"):
        query = intake.start_intake(self.spark, f"{self.root}/incoming", self.staging, self.states, COLUMNS, f"{self.root}/{checkpoint}", max_files)
        query.awaitTermination()

    @property
    def staging(self):
        return f"{self.root}/staging"

    def rows(self):
        return sorted(tuple(r)[1:] for r in intake.read_staged(self.spark, self.staging, COLUMNS).collect())

    def refused(self):
        return sorted((r["run_id"], r["reason"]) for r in intake.read_quarantine(self.spark, self.staging).collect())


@pytest.fixture()
def box(spark, tmp_path):
    return Box(spark, tmp_path)


def batch(seq, *rows):
    return {"seq": seq, "rows": [list(r) for r in rows]}


def test_intake_and_refusals(box):
    box.put(RUN, "b1", batch(1, ("1", "a"), ("2", None)))
    box.put(RUN, "b2", batch(2, ("3", "")), '{"seq":3,"rows":[["only one"]]}', "broken")
    box.put(SEALED, "b1", batch(1, ("9", "late")))
    box.put(UNKNOWN, "b1", batch(1, ("9", "lost")))
    box.run()
    assert box.rows() == [(1, 1, "1", "a"), (1, 2, "2", None), (2, 1, "3", "")]
    assert box.refused() == [(RUN, "BAD_SHAPE"), (RUN, "BAD_WIDTH"), (SEALED, "RUN_SEALED"), (UNKNOWN, "RUN_UNKNOWN")]


def test_later_copy_of_a_batch_wins(box):
    box.put(RUN, "b1", batch(1, ("1", "old"), ("2", "old")))
    box.put(RUN, "b1-again", batch(1, ("1", "new")))
    box.run()
    assert box.rows() == [(1, 1, "1", "new")]
    box.put(RUN, "b1-third", batch(1, ("1", "newest"), ("2", "x")))
    box.run()
    assert box.rows() == [(1, 1, "1", "newest"), (1, 2, "2", "x")]


def test_copies_in_one_file(box):
    box.put(RUN, "both", batch(1, ("1", "first")), batch(1, ("1", "second")))
    box.run()
    assert box.rows() == [(1, 1, "1", "second")]


def test_a_second_stream_adds_and_loses_nothing(box):
    """Another checkpoint reads the same files again; the rows stay single."""
    box.put(RUN, "b1", batch(1, ("1", "a")))
    box.run()
    box.put(RUN, "b2", batch(2, ("2", "b")))
    box.run(checkpoint="other")
    assert box.rows() == [(1, 1, "1", "a"), (2, 1, "2", "b")]


def test_nothing_staged_yet_is_empty(box):
    assert box.rows() == [] and box.refused() == []


def test_gaps_and_contiguity(box, spark):
    box.put(RUN, "b1", batch(1, ("1", "a")), batch(2, ("2", "b")), batch(4, ("4", "d")))
    box.run()
    assert [tuple(r) for r in intake.intake_gaps(spark, box.staging).collect()] == [(RUN, 3, 4)]
    expected = spark.createDataFrame([(RUN, 4)], "run_id string, source_batches bigint")
    assert intake.intake_report(spark, box.staging, expected).first()["contiguous"] is False
    box.put(RUN, "b3", batch(3, ("3", "c")))
    box.run()
    row = intake.intake_report(spark, box.staging, expected).first()
    assert (row["contiguous"], row["rows"], row["batches"]) == (True, 4, 4)


def test_seal_between_micro_batches(box):
    box.put(RUN, "b1", batch(1, ("1", "a")))
    box.run()
    box.sealed[RUN] = True
    box.put(RUN, "b2", batch(2, ("2", "late")))
    box.run()
    assert box.rows() == [(1, 1, "1", "a")]
    assert box.refused() == [(RUN, "RUN_SEALED")]


def test_a_retried_epoch_keeps_only_what_it_accepts_now(box, spark):
    """The run is sealed between two attempts of one epoch: its rows are refused, not staged as well."""
    other = "20240102030405_00000d"
    lines = [(f"{box.root}/incoming/{r}/b1.json", json.dumps(batch(1, (i, "a"))), 0) for r, i in ((RUN, "1"), (other, "2"))]
    read = spark.createDataFrame(lines, "source_file string, value string, source_block bigint")
    read = read.withColumn("arrived_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    for sealed in (False, True):
        box.sealed |= {RUN: sealed, other: False}
        judged = intake.judge_lines(read, box.states(spark), COLUMNS)
        intake.write_load(judged, box.staging, COLUMNS, "query-000000000000")
        assert len(box.rows()) == (1 if sealed else 2)
    assert box.rows() == [(1, 1, "2", "a")]
    assert box.refused() == [(RUN, "RUN_SEALED")]
    assert intake.read_ledger(spark, box.staging).count() == 1


def test_abort(box, spark):
    other = "20240102030405_00000d"
    box.sealed[other] = False
    box.put(RUN, "b1", batch(1, ("1", "a")))
    box.put(other, "b1", batch(1, ("7", "z")))
    box.run()
    states = box.states(spark)
    assert intake.abort_run(spark, box.staging, states, RUN) is True
    assert intake.abort_run(spark, box.staging, states, RUN) is False
    assert box.rows() == [(1, 1, "7", "z")]
    with pytest.raises(intake.RunSealed):
        intake.abort_run(spark, box.staging, states, SEALED)


def test_empty_batches_count(box, spark):
    box.put(RUN, "b1", batch(1), batch(2, ("2", "b")))
    box.run()
    expected = spark.createDataFrame([(RUN, 2)], "run_id string, source_batches bigint")
    assert intake.intake_report(spark, box.staging, expected).first()["contiguous"] is True


def test_live_table_over_several_micro_batches(spark, sf_dir, tmp_path):
    """The stream ends with the same runs as the batch fold."""
    from workload.jobs import _accepted, _log

    log = _log(spark, sf_dir)
    for i in range(4):
        log.filter(F.col("pos") % 4 == i).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    lines = live.log_stream(spark, str(tmp_path / "log"), log.schema, max_files=1)
    live.start_live_runs(lines, str(tmp_path / "states"), str(tmp_path / "checkpoint")).awaitTermination()
    assert len([d for d in os.listdir(tmp_path / "states") if d.startswith("epoch=")]) == 4
    streamed = live.live_runs(spark, str(tmp_path / "states"), _accepted(spark, sf_dir)).drop("run_params")
    batch_fold = history.run_history(log, _accepted(spark, sf_dir)).drop("run_params")
    assert streamed.exceptAll(batch_fold).count() == 0 and batch_fold.exceptAll(streamed).count() == 0


def test_live_table_after_a_new_checkpoint(spark, sf_dir, tmp_path):
    """A query that starts over reads all lines in one epoch; older states with higher epochs don't hide it."""
    from workload.jobs import _accepted, _log

    log = _log(spark, sf_dir)
    names = iter("abcd")

    def live_after(lines, max_files):
        lines.coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        stream = live.log_stream(spark, str(tmp_path / "log"), log.schema, max_files=max_files)
        live.start_live_runs(stream, str(tmp_path / "states"), str(tmp_path / next(names))).awaitTermination()
        streamed = live.live_runs(spark, str(tmp_path / "states"), _accepted(spark, sf_dir)).drop("run_params")
        return streamed

    middle = log.approxQuantile("pos", [0.5], 0.01)[0]
    log.filter(F.col("pos") < middle / 2).coalesce(1).write.json(str(tmp_path / "log"))
    live_after(log.filter((F.col("pos") >= middle / 2) & (F.col("pos") < middle)), 1)
    streamed = live_after(log.filter(F.col("pos") >= middle), None)
    batch_fold = history.run_history(log, _accepted(spark, sf_dir)).drop("run_params")
    assert streamed.exceptAll(batch_fold).count() == 0 and batch_fold.exceptAll(streamed).count() == 0


def test_lines_of_one_run_stay_dealt(spark):
    """All lines of a run would be one task if they were dealt by run to meet its state."""
    lines = spark.range(0, 800, 1, 8).select(
        F.format_string('{"seq":%d,"rows":[["%d","x"]]}', "id", "id").alias("value"), F.format_string(f"/in/{RUN}/%d.json", F.col("id") % 2).alias("source_file")
    )
    states = spark.range(3000).select(
        F.when(F.col("id") == 0, RUN).otherwise(F.concat(F.lit("r"), "id")).alias("run_id"), F.lit(False).alias("sealed")
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = intake.judge_lines(lines, states, COLUMNS)
        dealt = judged.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.count("reason").alias("refused")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [(r["n"], r["refused"]) for r in dealt] == [(100, 0)] * 8
