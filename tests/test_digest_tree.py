"""The located comparison against the plain one."""

import random
from decimal import Decimal

import pytest

from tableferry.operators import digest_tree
from tableferry.operators.verify import reconcile


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """40,000 rows in key order, in files by key range, and a target that differs in two places."""
    folder = str(tmp_path_factory.mktemp("digest"))
    source = spark.range(0, 400_000, 10, 16).selectExpr("id AS k", "'t' || (id % 97) AS a", "CAST(id / 7 AS DECIMAL(18,2)) AS b")
    source.write.parquet(f"{folder}/s")
    source.selectExpr(
        "k", "IF(k BETWEEN 210000 AND 210400, 'x', a) AS a", "CAST(b AS DECIMAL(20,4)) AS b"
    ).filter("k <> 390000").write.parquet(f"{folder}/t")
    return spark.read.parquet(f"{folder}/s"), spark.read.parquet(f"{folder}/t"), folder


@pytest.mark.parametrize("nodes, row_limit", [(4096, 0), (64, 0), (16, 1_000_000), (2, 10)])
def test_tree_equals_plain_comparison(wide, nodes, row_limit):
    s, t, _ = wide
    assert _rows(digest_tree.reconcile_tree(s, t, ["k"], nodes, row_limit)) == _rows(reconcile(s, t, ["k"]))


def test_descent_reads_only_what_differs(wide):
    s, t, _ = wide
    found = digest_tree.locate(s, t, ["k"], nodes=64, row_limit=0)
    assert len(found.levels) > 1
    assert found.levels[1][1] <= 64 + 2  # The second level has the nodes of those that differed, not all.
    assert sum(end - begin for begin, end in found.ranges()) < 2_000
    keys = [*range(210_000, 210_401, 10), 390_000]
    assert all(any(begin <= k < end for begin, end in found.ranges()) for k in keys)


def test_equal_ranges_are_not_read_again(spark, wide):
    s, t, folder = wide
    aligned, _ = digest_tree._aligned(s, t, ["k"])
    found = digest_tree.locate(s, t, ["k"])
    part = digest_tree._restricted(aligned, ["k"], found, False)
    # The 16 files are key ranges: only those around the two places give any row, and the scan is told the ranges.
    assert part.selectExpr("input_file_name()").distinct().count() == 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(k," in plan


def test_any_key_and_nulls(spark):
    rows = [("a", 1, Decimal("1.50"), None), ("a", 2, None, b"\xff"), ("b", 1, Decimal("2.00"), b""), (None, 1, None, None), ("c", None, None, None)]
    schema = "k string, n int, v decimal(10,2), w binary"
    s = spark.createDataFrame(rows, schema)
    t = spark.createDataFrame([rows[0], ("a", 2, None, b"\xfe"), *rows[3:], ("d", 9, None, None)], schema)
    for nodes in (2, 4096):
        got = _rows(digest_tree.reconcile_tree(s, t, ["k", "n"], nodes, 0))
        assert got == _rows(reconcile(s, t, ["k", "n"]))
    empty = spark.createDataFrame([], schema)
    for left, right in ((empty, t), (s, empty), (empty, empty)):
        assert _rows(digest_tree.reconcile_tree(left, right, ["n"])) == _rows(reconcile(left, right, ["n"]))


def test_random_differences(spark):
    pick = random.Random(5)
    for _ in range(3):
        left = {pick.randrange(-(2**40), 2**40): pick.randrange(5) for _ in range(300)}
        right = {k: pick.randrange(5) if pick.random() < 0.1 else v for k, v in left.items() if pick.random() < 0.95}
        right |= {pick.randrange(-(2**40), 2**40): 1 for _ in range(5)}
        s, t = (spark.createDataFrame(list(side.items()), "k bigint, v int") for side in (left, right))
        assert _rows(digest_tree.reconcile_tree(s, t, ["k"], 8, 0)) == _rows(reconcile(s, t, ["k"]))


def test_extreme_keys_take_hashes(spark):
    s = spark.createDataFrame([(-(2**63), 1), (2**63 - 1, 2)], "k bigint, v int")
    t = spark.createDataFrame([(-(2**63), 1), (2**63 - 1, 3)], "k bigint, v int")
    assert _rows(digest_tree.reconcile_tree(s, t, ["k"])) == [("v", 2, 1, 0, 0)]
    with pytest.raises(TypeError):
        nested = s.selectExpr("k", "array(v) AS v")
        digest_tree.reconcile_tree(nested, nested, ["k"])


def test_many_places_are_merged_over_the_smallest_gaps():
    found = digest_tree.Located(100, 2, nodes=[0, 1, 5, 6, 50])
    assert found.ranges() == [(100, 108), (120, 128), (300, 304)]
    assert found.ranges(2) == [(100, 128), (300, 304)]
