"""Row and batch numbering against plain loops on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tableferry.operators import numbering
from tableferry.sources.payload import write_payloads


def greedy(rows, row_limit, budget):
    """The batches of one ordered pass: cut before a limit would be passed."""
    batches, current = [], []
    for row in rows:
        candidate = len(json.dumps({"seq": len(batches) + 1, "rows": current + [row]}, ensure_ascii=False, separators=(",", ":")).encode())
        if current and (len(current) == row_limit or candidate > budget):
            batches.append(current)
            current = []
        current.append(row)
    return batches + ([current] if current else [])


@pytest.fixture(scope="module")
def texts(spark):
    pick = random.Random(7)
    rows = [(i, pick.choice(["x", "é", '"q"', "甲\n", "😀", "\x01\t\\", "\x7f/"]) * pick.randrange(0, 60)) for i in range(3000)]
    rows[1500] = (1500, "z" * 5000)
    rows[2999] = (2999, None)
    return rows


@pytest.mark.parametrize("row_limit, budget", [(7, 10**6), (5000, 900), (40, 2000), (1, 10**6)])
def test_one_range_is_the_plain_greedy_cut(spark, texts, row_limit, budget):
    df = spark.createDataFrame(texts, "id bigint, v string").repartition(5)
    got = numbering.assign_batches(df, [F.col("id")], row_limit=row_limit, byte_budget=budget, partitions=1)
    expected = greedy([[str(i), v] for i, v in texts], row_limit, budget)
    numbers = {int(c[0]): (b + 1, r + 1) for b, batch in enumerate(expected) for r, c in enumerate(batch)}
    assert {r["id"]: (r["batch_no"], r["row_no"]) for r in got.collect()} == numbers


@pytest.mark.parametrize("order", [["id"], []])
def test_many_ranges_keep_the_limits(spark, texts, order):
    df = spark.createDataFrame(texts, "id bigint, v string").repartition(5)
    row_limit, budget = 40, 2000
    got = numbering.assign_batches(df, [F.col(c) for c in order], row_limit=row_limit, byte_budget=budget, partitions=6)
    sent = write_payloads(got, F.array(F.col("id").cast("string"), F.col("v"))).orderBy("batch_no").collect()
    assert [r["batch_no"] for r in sent] == list(range(1, len(sent) + 1))
    assert sum(r["rows"] for r in sent) == len(texts)
    assert all(r["rows"] <= row_limit and (r["bytes"] <= budget or r["rows"] == 1) for r in sent)
    ids = [int(row[0]) for r in sent for row in json.loads(r["payload"])["rows"]]
    assert sorted(ids) == list(range(3000))
    if order:
        assert ids == list(range(3000))
        assert len(sent) <= len(greedy([[str(i), v] for i, v in texts], row_limit, budget)) + 5


def test_hot_order_value_spreads(spark):
    """A third of the rows share one order value and still land in several ranges."""
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100).alias("k"))
    kept = numbering._ranged(df, [F.col("k")], 8)
    sizes = [r["count"] for r in kept.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 2400
    numbered = numbering.number_rows(df, [F.col("k")], partitions=8).orderBy("rn").collect()
    assert [r["rn"] for r in numbered] == list(range(1, 9001))
    assert [r["k"] for r in numbered] == sorted(r["k"] for r in numbered)


def test_page(spark):
    df = spark.range(30000).select((F.col("id") * 7919 % 30000).alias("id"))
    got = [r["id"] for r in numbering.page(df, [F.col("id")], 10001, 15000).collect()]
    assert sorted(got) == list(range(10000, 15000))


def test_empty_table(spark):
    df = spark.range(0)
    assert numbering.number_rows(df, [F.col("id")]).collect() == []
    assert numbering.assign_batches(df, [F.col("id")]).collect() == []


def test_running_total_in_chunks(spark):
    pick = random.Random(3)
    rows = [("hot" if i % 3 else f"r{i % 5}", i, pick.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "run string, seq bigint, rows bigint")
    got = numbering.running_total(df, ["run"], "seq", "rows", "total", chunk=64).collect()
    sums, expected = {}, {}
    for run, seq, n in rows:
        sums[run] = sums.get(run, 0) + n
        expected[run, seq] = sums[run]
    assert {(r["run"], r["seq"]): r["total"] for r in got} == expected


def test_sequence_gaps(spark):
    numbers = [1, 2, 3, 5, 6, 64, 65, 200, 201]
    df = spark.createDataFrame([("a", n) for n in numbers] + [("b", 1), ("b", 2), ("b", 2), ("c", 4)], "run_id string, batch_no bigint")
    got = sorted((r["run_id"], r["expected"], r["got"]) for r in numbering.sequence_gaps(df, chunk=64).collect())
    assert got == [("a", 4, 5), ("a", 7, 64), ("a", 66, 200), ("c", 1, 4)]


def test_scratch_tables_can_be_dropped(spark):
    from tableferry.scratch import drop_scratch, scratch_folder, scratch_path

    numbering.number_rows(spark.range(10), [F.col("id")]).collect()
    assert scratch_path(spark, "x").startswith(f"{scratch_folder(spark)}/tableferry/{spark.sparkContext.applicationId}/x-")
    assert drop_scratch(spark) is True
    assert drop_scratch(spark) is False
