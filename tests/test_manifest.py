"""Publishing by a manifest of buckets: what is rewritten, what stays, and runs that overlap."""

import glob
import os

import pytest
from pyspark.sql import types as T

from tableferry import ColumnMapping, TaskSpec
from tableferry.operators.upsert import upsert
from tableferry.plans.copy_run import CopyPlan, CopyRefused, run_copy
from tableferry.sources import files
from tableferry.sources.manifest import ManifestTarget, bucket_number
from tableferry.sources.publish import TargetBusy

SCHEMA = T.StructType().add("ID", T.DecimalType(12, 0)).add("V", T.StringType())
BUCKETS = 8


@pytest.fixture()
def target(tmp_path):
    return ManifestTarget(str(tmp_path / "target"), SCHEMA, ("ID",), BUCKETS)


def staged(spark, *rows):
    return spark.createDataFrame(list(rows), "ID bigint, V string").to(SCHEMA)


def bucket_of(spark, *ids):
    df = staged(spark, *[(i, "") for i in ids])
    return {int(r[0]): r[1] for r in df.select("ID", bucket_number([df["ID"]], BUCKETS)).collect()}


def put(spark, target, run_id, rows, based_on="now", check=None):
    based_on = target.current(spark) if based_on == "now" else based_on
    old, untouched = target.affected(spark, rows, based_on)
    target.publish(upsert(old, rows, ["ID"]).drop("_effect"), run_id, check, based_on)
    return untouched


def content(spark, target):
    return {int(r["ID"]): r["V"] for r in target.read(spark).collect()}


def stamps(target):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{target.path}/data/**/part-*", recursive=True)}


def test_untouched_files_stay(spark, target):
    put(spark, target, "r1", staged(spark, *[(i, "old") for i in range(200)]))
    before, buckets = stamps(target), bucket_of(spark, *range(210))
    untouched = put(spark, target, "r2", staged(spark, (3, "new"), (205, "more")))
    touched = {buckets[3], buckets[205]}
    assert content(spark, target) == {i: "old" for i in range(200)} | {3: "new", 205: "more"}
    assert untouched == sum(buckets[i] not in touched for i in range(200))
    after = stamps(target)
    assert all(after[p] == t for p, t in before.items())
    entries = target.entries(spark, "r2")
    assert {b for b, (folder, _) in entries.items() if "run=r2" in folder} == touched
    assert {b: n for b, (_, n) in entries.items()} == {b: sum(buckets[i] == b for i in content(spark, target)) for b in entries}


def test_only_files_that_no_reader_can_ask_for_go(spark, target):
    for n, rows in enumerate([[(i, "a") for i in range(60)], [(1, "b")], [(1, "c")], [(2, "d")]]):
        put(spark, target, f"r{n}", staged(spark, *rows))
    assert content(spark, target) == {i: "a" for i in range(60)} | {1: "c", 2: "d"}
    assert files.child_names(spark, f"{target.path}/manifests") == ["r2.json", "r3.json"]
    previous = {folder for folder, _ in target.entries(spark, "r2").values()}
    current = {folder for folder, _ in target.entries(spark, "r3").values()}
    held = {p.removeprefix(f"{target.path}/").rpartition("/")[0] for p in stamps(target)}
    assert held == previous | current


def test_overlapping_runs_on_different_buckets_both_land(spark, target):
    put(spark, target, "r1", staged(spark, *[(i, "old") for i in range(50)]))
    buckets = bucket_of(spark, *range(50))
    other = next(i for i in range(50) if buckets[i] != buckets[0])
    put(spark, target, "r3", staged(spark, (0, "three")), "r1", lambda: put(spark, target, "r2", staged(spark, (other, "two")), "r1"))
    assert target.current(spark) == "r3" and target._manifest(spark, "r3")["follows"] == "r2"
    assert content(spark, target) == {i: "old" for i in range(50)} | {0: "three", other: "two"}


def test_overlapping_runs_on_a_common_bucket_fail(spark, target):
    put(spark, target, "r1", staged(spark, *[(i, "old") for i in range(50)]))
    with pytest.raises(TargetBusy):
        put(spark, target, "r3", staged(spark, (0, "three")), "r1", lambda: put(spark, target, "r2", staged(spark, (0, "two")), "r1"))
    assert content(spark, target)[0] == "two" and target.current(spark) == "r2"
    assert not files.exists(spark, f"{target.path}/data/run=r3") and not files.exists(spark, f"{target.path}/manifests/r3.json")
    # A new key in a bucket that the other run wrote is a common bucket as well.
    with pytest.raises(TargetBusy):
        put(spark, target, "r4", staged(spark, (0, "four")), "r1")
    put(spark, target, "r5", staged(spark, (0, "five")))
    assert content(spark, target)[0] == "five"


def test_a_dead_run_can_be_repeated(spark, target, monkeypatch):
    put(spark, target, "r1", staged(spark, (1, "old"), (2, "old")))
    from tableferry.sources import manifest

    class Died(BaseException):
        pass

    def die(*args):
        raise Died

    # Killed between claim and switch: nothing of the cleaning ran either.
    with monkeypatch.context() as m:
        m.setattr(manifest, "remove", lambda *a: False)
        m.setattr(manifest, "replace_text", lambda s, path, *a: die() if path.endswith("CURRENT") else files.replace_text(s, path, *a))
        with pytest.raises(Died):
            put(spark, target, "r2", staged(spark, (1, "new")))
    assert content(spark, target) == {1: "old", 2: "old"} and not target.published(spark, "r2")
    with pytest.raises(TargetBusy):
        put(spark, target, "r3", staged(spark, (2, "x")))
    put(spark, target, "r2", staged(spark, (1, "new")))
    assert content(spark, target) == {1: "new", 2: "old"} and target.published(spark, "r2")
    put(spark, target, "r4", staged(spark, (2, "x")))
    assert target.published(spark, "r2") and not target.published(spark, "r9")
    with pytest.raises(ValueError, match="already"):
        put(spark, target, "r2", staged(spark, (1, "again")))


def test_failed_check_leaves_the_target(spark, target):
    put(spark, target, "r1", staged(spark, (1, "old")))

    def broken():
        raise CopyRefused("VERIFY_FAILED", "no")

    with pytest.raises(CopyRefused):
        put(spark, target, "r2", staged(spark, (1, "new")), check=broken)
    assert content(spark, target) == {1: "old"} and not files.exists(spark, f"{target.path}/data/run=r2")


def test_copy_runs_into_a_manifest(spark, target, tmp_path):
    spec = TaskSpec("APP", "SRC", "TGT", ("ID",), (ColumnMapping("id", "ID"), ColumnMapping("v", "V")))
    plan = CopyPlan(spec, target, str(tmp_path / "staging"))
    source = lambda *rows: spark.createDataFrame(list(rows), "id int, v string")
    first = run_copy(spark, plan, source(*[(i, "a") for i in range(40)]))
    assert (first.inserted, first.kept) == (40, 0)
    second = run_copy(spark, plan, source((5, "b"), (41, "n"), (6, "a")))
    assert (second.inserted, second.updated, second.unchanged, second.kept) == (1, 1, 1, 38)
    nothing = run_copy(spark, plan, source((1, "x")).limit(0))
    assert nothing.kept == 41 and content(spark, target) == {i: "a" for i in range(40)} | {5: "b", 41: "n"}
    with pytest.raises(ValueError, match="byte by byte"):
        run_copy(spark, CopyPlan(spec, target, str(tmp_path / "staging"), collation="UNICODE_CI"), source((1, "x")))


def test_an_empty_target_reads_empty(spark, target):
    assert target.read(spark).count() == 0 and target.read(spark).schema == SCHEMA
    put(spark, target, "r0", staged(spark, (1, "x")).limit(0))
    assert target.current(spark) == "r0" and target.read(spark).count() == 0
