"""From intake to target: states, gate, publish, and what a dead process leaves."""

import json
import os

import pytest
from pyspark.sql import types as T

from tableferry.plans import history
from tableferry.sources import runlog
from tableferry.sources.manifest import ManifestTarget
from tableferry.sources.publish import FolderTarget, TargetBusy
from tableferry.streaming import commit, intake
from tableferry.streaming.commit import CommitRefused, IntakeCommit, RunStates, RunUnknown, StateMoved

RUN, OTHER = "20240102030405_00000a", "20240102030405_00000b"
SCHEMA = T.StructType().add("ID", T.LongType()).add("V", T.DecimalType(6, 2))


class Desk:
    def __init__(self, spark, root, target):
        self.spark, self.root, self.target, self.n = spark, str(root), target, 0
        self.states = RunStates(spark, f"{root}/states")
        self.work = IntakeCommit(spark, self.states, f"{root}/staging", target, ["ID", "V"], ["ID"], f"{root}/log")

    def send(self, run, *batches):
        self.n += 1
        folder = f"{self.root}/incoming/{run}"
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{self.n:03d}.json"
        with open(path, "w") as out:
            out.writelines(json.dumps({"seq": seq, "rows": rows}) + "\n" for seq, rows in batches)
        os.utime(path, (1_700_000_000 + self.n,) * 2)
        intake.start_intake(self.spark, f"{self.root}/incoming", f"{self.root}/staging", self.states.table, ["ID", "V"], f"{self.root}/checkpoint").awaitTermination()

    def content(self):
        return {r["ID"]: str(r["V"]) for r in self.target.read(self.spark).collect()}

    def state(self, run=RUN):
        return self.states.last(run)[1]["state"]

    def staged(self, run=RUN):
        return intake.read_staged(self.spark, f"{self.root}/staging", ["ID", "V"]).filter(f"run_id = '{run}'").count()

    def refused(self):
        return sorted((r["run_id"], r["reason"]) for r in intake.read_quarantine(self.spark, f"{self.root}/staging").collect())


@pytest.fixture(params=["manifest", "folder"])
def desk(spark, tmp_path, request):
    made = {"manifest": lambda p: ManifestTarget(p, SCHEMA, ("ID",), 4), "folder": lambda p: FolderTarget(p, SCHEMA)}
    return Desk(spark, tmp_path, made[request.param](f"{tmp_path}/target"))


def opened(desk, run=RUN, *batches):
    desk.states.open(run)
    desk.send(run, *(batches or ((1, [["1", "1.00"], ["2", "2.00"]]), (2, [["3", "3.00"]]))))


def test_commit_publishes_the_copies_in_force(desk):
    opened(desk)
    desk.send(RUN, (2, [["3", "33.00"]]))
    done = desk.work.commit(RUN, 3, 2)
    assert (done["state"], done["source_rows"], done["staged_rows"], done["sink_reported_rows"], done["received_batches"]) == ("PUBLISHED", 3, 3, 3, 2)
    assert desk.content() == {1: "1.00", 2: "2.00", 3: "33.00"} and desk.staged() == 0
    desk.send(RUN, (3, [["4", "4.00"]]))
    desk.send("20240102030405_0000ff", (1, [["9", "9.00"]]))
    assert desk.refused() == [(RUN, "RUN_SEALED"), ("20240102030405_0000ff", "RUN_UNKNOWN")]
    with pytest.raises(intake.RunSealed):
        desk.work.commit(RUN, 3, 2)
    with pytest.raises(intake.RunSealed):
        desk.work.abort(RUN)
    with pytest.raises(RunUnknown):
        desk.work.commit(OTHER, 0, 0)


@pytest.mark.parametrize(
    "batches,rows,total,kind,cause",
    [
        (((1, [["1", "1.00"]]), (2, [["2", "2.00"]])), 3, 3, "VERIFY_FAILED", "BATCH_NOT_DELIVERED"),
        (((1, [["1", "1.00"]]), (3, [["2", "2.00"]])), 2, 2, "VERIFY_FAILED", "BATCH_NOT_DELIVERED"),
        (((1, [["1", "1.005"]]),), 1, 1, "DATA_REJECTED", None),
        (((1, [["1", "x"]]),), 1, 1, "DATA_REJECTED", None),
        (((1, [["1", "1.00"], ["1", "2.00"]]),), 2, 1, "DATA_REJECTED", None),
        (((1, [[None, "1.00"]]),), 1, 1, "DATA_REJECTED", None),
    ],
)
def test_a_failed_run_is_discarded(spark, tmp_path, batches, rows, total, kind, cause):
    desk = Desk(spark, tmp_path, FolderTarget(f"{tmp_path}/target", SCHEMA))
    opened(desk, RUN, *batches)
    with pytest.raises(CommitRefused) as refused:
        desk.work.commit(RUN, rows, total)
    assert refused.value.kind == kind and set(refused.value.numbers) == {
        "source_rows", "source_batches", "staged_rows", "sink_reported_rows", "received_batches"
    }
    last = desk.states.last(RUN)[1]
    assert (last["state"], last["kind"], last.get("cause")) == ("ABORTED", kind, cause) and desk.staged() == 0
    assert desk.target.current(spark) is None
    folded = history.combine_states(history.fold_states(runlog.read_log(spark, f"{tmp_path}/log/*/*", runlog.RECORD_FOLDER))).first()
    assert (folded["outcome"], folded["failure_kind"]) == ("FAILED", kind)


def test_lost_rows_are_told_from_missing_batches(spark, tmp_path, monkeypatch):
    desk = Desk(spark, tmp_path, FolderTarget(f"{tmp_path}/target", SCHEMA))
    opened(desk)
    whole = IntakeCommit._staged
    monkeypatch.setattr(IntakeCommit, "_staged", lambda self, run: whole(self, run).filter("ID <> '2'"))
    with pytest.raises(CommitRefused, match="LOST_IN_WRITE: source_rows 3, source_batches 2, staged_rows 2, sink_reported_rows 3, received_batches 2"):
        desk.work.commit(RUN, 3, 2)


def test_a_busy_target_discards_the_run(desk, monkeypatch, tmp_path, spark):
    opened(desk)

    def busy(*args, **kwargs):
        raise TargetBusy("target", None)

    monkeypatch.setattr(type(desk.target), "publish", busy)
    with pytest.raises(CommitRefused, match="TARGET_BUSY"):
        desk.work.commit(RUN, 3, 2)
    assert desk.states.last(RUN)[1]["kind"] == "TARGET_BUSY" and desk.staged() == 0
    folded = history.combine_states(history.fold_states(runlog.read_log(spark, f"{tmp_path}/log/*/*", runlog.RECORD_FOLDER))).first()
    assert (folded["failure_kind"], folded["sink_code"]) == ("TARGET_BUSY", "SWAP_TARGET_BUSY")


class Died(BaseException):
    pass


@pytest.mark.parametrize("step", ["_numbers", "_publish", "_log", "_drop"])
def test_recovery_goes_on_after_any_step(desk, monkeypatch, step):
    opened(desk)
    opened(desk, OTHER, (1, [["2", "7.00"]]))

    def die(*args, **kwargs):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(IntakeCommit, step, die)
        with pytest.raises(Died):
            desk.work.commit(RUN, 3, 2)
    assert desk.work.recover() == [RUN] and desk.work.recover() == []
    assert desk.state() == "PUBLISHED" and desk.state(OTHER) == "OPEN" and desk.staged() == 0 and desk.staged(OTHER) == 1
    assert desk.content() == {1: "1.00", 2: "2.00", 3: "3.00"}


def test_a_switch_without_its_state_is_not_repeated(spark, tmp_path, monkeypatch):
    desk = Desk(spark, tmp_path, ManifestTarget(f"{tmp_path}/target", SCHEMA, ("ID",), 4))
    opened(desk)
    opened(desk, OTHER, (1, [["2", "7.00"]]))
    real = RunStates.move

    def die(self, run, to, **details):
        if run == RUN and to == "PUBLISHED":
            raise Died
        real(self, run, to, **details)

    with monkeypatch.context() as m:
        m.setattr(RunStates, "move", die)
        with pytest.raises(Died):
            desk.work.commit(RUN, 3, 2)
    # Another run publishes before the first one is recovered: its change of row 2 must stay.
    desk.work.commit(OTHER, 1, 1)
    assert desk.work.recover() == [RUN] and desk.state() == "PUBLISHED"
    assert desk.content() == {1: "1.00", 2: "7.00", 3: "3.00"}


def test_abort(desk):
    opened(desk)
    assert desk.work.abort(RUN) is True and desk.work.abort(RUN) is False and desk.work.abort(OTHER) is False
    assert desk.state() == "ABORTED" and desk.target.current(desk.spark) is None
    desk.send(RUN, (3, [["4", "4.00"]]))
    assert desk.refused() == [(RUN, "RUN_SEALED")]


def test_only_one_of_two_callers_moves_a_run(spark, tmp_path, monkeypatch):
    states = RunStates(spark, f"{tmp_path}/states")
    states.open(RUN)
    seen = states.last(RUN)
    states.move(RUN, commit.SEALED)
    # The second caller still sees the run open.
    monkeypatch.setattr(RunStates, "last", lambda self, run: seen)
    with pytest.raises(StateMoved):
        states.move(RUN, commit.ABORTED)
    monkeypatch.undo()
    assert states.last(RUN)[1]["state"] == "SEALED"
    assert [tuple(r) for r in states.table().collect()] == [(RUN, "SEALED", True)]
    with pytest.raises(intake.RunSealed):
        states.open(RUN)
