"""Folders of epochs: what is folded when, what a reader sees, repeats and lost writes."""

import os

import pytest
from pyspark.sql import functions as F

from tableferry.plans import history
from tableferry.streaming import live
from tableferry.streaming.epochs import EpochFolders, Piece, uncovered


def _total(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def _one(spark, epoch):
    return spark.range(1).selectExpr(f"CAST({epoch % 2} AS INT) k", f"{epoch}L n")


def _sums(folders, spark):
    return {r["k"]: r["n"] for r in _total(folders.read(spark)).collect()}


def test_folders_stay_few_and_hold_every_epoch(spark, tmp_path):
    folders = EpochFolders(str(tmp_path), fan=3)
    for epoch in range(28):
        folders.write(_one(spark, epoch), "q", epoch, _total)
        assert len(uncovered(folders.pieces(spark))) <= 2 * 3 + 3
        assert len(os.listdir(tmp_path)) <= 4 * 3 + 3
    assert [(p.first, p.last) for p in uncovered(folders.pieces(spark))] == [(0, 26), (27, 27)]
    assert _sums(folders, spark) == {0: sum(range(0, 28, 2)), 1: sum(range(1, 28, 2))}


def test_a_repeated_epoch_and_an_unfinished_fold_change_nothing(spark, tmp_path):
    folders = EpochFolders(str(tmp_path), fan=2)
    for epoch in (0, 1, 2, 2, 3, 3):
        folders.write(_one(spark, epoch), "q", epoch, _total)
    # A fold that died: files are there, the mark is not.
    _one(spark, 99).write.parquet(str(tmp_path / "fold=q-000000000000-000000000003"))
    os.remove(tmp_path / "fold=q-000000000000-000000000003" / "_SUCCESS")
    assert _sums(folders, spark) == {0: 2, 1: 4}
    folders.write(_one(spark, 4), "q", 4, _total)
    assert [(p.first, p.last) for p in uncovered(folders.pieces(spark))] == [(0, 3), (4, 4)]
    folders.write(_one(spark, 4), "q", 4, _total)
    assert _sums(folders, spark) == {0: 6, 1: 4}


def test_queries_and_fans_do_not_mix(spark, tmp_path):
    for epoch in range(5):
        EpochFolders(str(tmp_path), fan=2).write(_one(spark, epoch), "a-b", epoch, _total)
    for epoch in range(5, 8):
        EpochFolders(str(tmp_path), fan=3).write(_one(spark, epoch), "a-b", epoch, _total)
    EpochFolders(str(tmp_path)).write(_one(spark, 100), "c", 0, _total)
    folders = EpochFolders(str(tmp_path))
    # At epoch 6 the piece of epochs 0 to 3 begins before the range of three, so 4 and 5 alone are folded.
    assert [(p.query, p.first, p.last) for p in uncovered(folders.pieces(spark))] == [
        ("a-b", 0, 3), ("a-b", 4, 5), ("a-b", 6, 6), ("a-b", 7, 7), ("c", 0, 0),
    ]
    assert _sums(folders, spark) == {0: 0 + 2 + 4 + 6 + 100, 1: 1 + 3 + 5 + 7}


def test_nothing_written_and_bad_fan(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        EpochFolders(str(tmp_path / "none")).read(spark)
    with pytest.raises(ValueError):
        EpochFolders("x", fan=1)
    assert uncovered([]) == []
    a, b, c = Piece("x", "q", 0, 8), Piece("y", "q", 3, 5), Piece("z", "r", 4, 4)
    assert uncovered([c, b, a]) == [a, c]


def test_live_table_keeps_no_state_and_takes_late_lines(spark, sf_dir, tmp_path):
    """Nine micro-batches with the lines of every run in any order, then one that comes after all had ended."""
    from workload.jobs import _accepted, _log

    log = _log(spark, sf_dir)
    late = F.col("pos") % 10 == 9
    log.filter(~late).repartition(9, "pos").write.json(str(tmp_path / "log"))
    for lines in (None, log.filter(late)):
        if lines is not None:
            lines.coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        stream = live.log_stream(spark, str(tmp_path / "log"), log.schema, max_files=1)
        query = live.start_live_runs(stream, str(tmp_path / "states"), str(tmp_path / "checkpoint"), fan=3)
        query.awaitTermination()
        assert query.recentProgress and not any(p["stateOperators"] for p in query.recentProgress)
    current = uncovered(EpochFolders(str(tmp_path / "states")).pieces(spark))
    assert [(p.first, p.last) for p in current] == [(0, 8), (9, 9)]
    streamed = live.live_runs(spark, str(tmp_path / "states"), _accepted(spark, sf_dir)).drop("run_params")
    batch_fold = history.run_history(log, _accepted(spark, sf_dir)).drop("run_params")
    assert streamed.exceptAll(batch_fold).count() == 0 and batch_fold.exceptAll(streamed).count() == 0
