"""Upsert, key guards and verification."""

import pytest
from pyspark.sql import functions as F

from tableferry.operators import upsert, verify
from tableferry.spec import OrderTerm


@pytest.fixture()
def target(spark):
    return spark.createDataFrame([(1, "one", "n1"), (2, "two", "n2"), (900, "sentinel", "keep")], "id int, v string, note string")


@pytest.fixture()
def staged(spark, tmp_path):
    """Staged rows as files, whose size Spark knows."""
    rows = spark.createDataFrame([(1, "one"), (2, "TWO"), (3, None)], "id int, v string")
    rows.write.parquet(str(tmp_path / "staged"))
    return spark.read.parquet(str(tmp_path / "staged"))


EXPECTED = [(1, "one", "n1", "unchanged"), (2, "TWO", "n2", "updated"), (3, None, "new", "inserted"), (900, "sentinel", "keep", "kept")]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_both_plans_agree(spark, target, staged, threshold):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        merged = upsert.upsert(target, staged, ["id"], {"note": "new"})
        assert ("FullOuter" in merged._jdf.queryExecution().optimizedPlan().toString()) == (threshold == "-1")
        assert sorted(tuple(r) for r in merged.collect()) == EXPECTED
        counts = upsert.effect_counts(merged).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert (counts["inserted"], counts["updated"], counts["unchanged"], counts["kept"]) == (1, 1, 1, 1)
    assert counts["staged_rows"] <= counts["affected"] == 4 <= 2 * counts["staged_rows"]


def test_small_staging_leaves_the_target_unshuffled(spark, sf_dir, staged):
    big = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS id", "o_orderstatus AS v", "o_orderpriority AS note")
    merged = upsert.upsert(big, staged, ["id"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    old_side = plan.split("LeftAnti")[0]
    assert "LeftOuter, BuildRight" in old_side and "FullOuter" not in plan
    assert "Exchange hashpartitioning" not in old_side


def test_key_spelling_stays_under_a_collation(spark):
    t = spark.createDataFrame([("A", 1)], "k string, v int")
    s = spark.createDataFrame([("a", 2), ("é", 3)], "k string, v int")
    merged = upsert.upsert(t, s, ["k"], collation="UNICODE_CI_AI")
    assert sorted(tuple(r) for r in merged.collect()) == [("A", 2, "updated"), ("é", 3, "inserted")]
    assert len(upsert.upsert(t, s, ["k"]).collect()) == 3


def test_all_columns_are_keys(spark):
    t = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    s = spark.createDataFrame([(2, 2), (3, 3)], "a int, b int")
    assert sorted(tuple(r) for r in upsert.insert_new(t, s, ["a", "b"]).collect()) == [(1, 1), (2, 2), (3, 3)]
    merged = upsert.upsert(t, s, ["a", "b"])
    assert sorted(r["_effect"] for r in merged.collect()) == ["inserted", "kept", "unchanged"]


def test_silent_rounding_is_not_possible_on_overflow(spark):
    t = spark.sql("SELECT 1 AS id, CAST(1 AS DECIMAL(3,0)) AS n")
    s = spark.sql("SELECT 1 AS id, CAST(12345 AS DECIMAL(10,0)) AS n")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|cannot be represented"):
        upsert.upsert(t, s, ["id"]).collect()


def test_key_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "id int, v string")
    row = upsert.key_report(df, ["id"]).first()
    assert tuple(row) == (5, 2, 2, 1, 1)
    assert [tuple(r) for r in upsert.duplicate_keys(df.filter("id IS NOT NULL"), ["id"]).collect()] == [(1, 2)]
    assert tuple(upsert.key_report(df.limit(0), ["id"]).first()) == (0, 0, 0, 0, 0)


def test_keep_latest_follows_the_task_order(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (1, 7, "c"), (2, 1, "d")], "id int, o int, v string")
    up = upsert.keep_latest(df, ["id"], [OrderTerm("o")])
    assert sorted(r["v"] for r in up.collect()) == ["b", "d"]
    down = upsert.keep_latest(df, ["id"], [OrderTerm("o", "desc")])
    assert sorted(r["v"] for r in down.collect()) == ["a", "d"]


def test_keep_latest_cuts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = upsert.keep_latest(df, ["k"], [OrderTerm("id")])._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_gate(spark):
    rows = [("ok", 5, 1, 5, 5, 1), ("lost", 5, 1, 4, 5, 1), ("undelivered", 5, 2, 3, 3, 1), ("empty", 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "run_id string, source_rows bigint, source_batches bigint, staged_rows bigint, sink_reported_rows bigint, received_batches bigint")
    got = {r["run_id"]: (r["verdict"], r["cause"]) for r in verify.verify_gate(df).collect()}
    assert got == {
        "ok": ("PASSED", None), "lost": ("VERIFY_FAILED", "LOST_IN_WRITE"),
        "undelivered": ("VERIFY_FAILED", "BATCH_NOT_DELIVERED"), "empty": ("PASSED", None),
    }


def test_contiguity(spark):
    batches = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3), ("b", 1), ("b", 3), ("c", 2)], "run_id string, batch_no bigint")
    expected = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1), ("none", 0), ("lost", 2)], "run_id string, source_batches bigint")
    got = {r["run_id"]: r["contiguous"] for r in verify.batch_contiguity(batches, expected).collect()}
    assert got == {"a": True, "b": False, "c": False, "none": True, "lost": False}


def test_digest(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", "b")], "i int, v string, w string")
    base = verify.table_digest(df).first()
    assert verify.table_digest(df.orderBy(F.desc("i"))).first() == base
    moved = spark.createDataFrame([(1, "a", ""), (2, None, "b")], "i int, v string, w string")
    shifted = spark.createDataFrame([(1, None, "a"), (2, "b", "")], "i int, v string, w string")
    twice = df.unionAll(df).unionAll(df)
    assert len({verify.table_digest(d).first() for d in (df, moved, shifted, twice)}) == 4
    assert tuple(verify.table_digest(df.limit(0)).first()) == (0, "0:0:0:0:0", "0:0:0:0:0")


def test_reconcile_pads_decimals_and_compares_bytes(spark):
    s = spark.sql("SELECT * FROM VALUES (1, CAST(1.5 AS DECIMAL(10,1)), 'AB  '), (2, CAST(2 AS DECIMAL(10,1)), 'é'), (3, NULL, NULL) AS t(id, n, v)")
    t = spark.sql("SELECT * FROM VALUES (1, CAST(1.50 AS DECIMAL(10,2)), 'AB'), (2, CAST(2 AS DECIMAL(10,2)), 'é'), (4, NULL, NULL) AS t(id, n, v)")
    got = {r["column_name"]: tuple(r)[1:] for r in verify.reconcile(s, t, ["id"]).collect()}
    assert got == {"n": (2, 0, 1, 1), "v": (2, 1, 1, 1)}


def test_snapshot_diff_is_a_set_difference(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    b = spark.createDataFrame([(2,), (3,), (3,), (None,)], "id int")
    assert tuple(verify.snapshot_diff(a, b).first()) == (1, 1, 2)
