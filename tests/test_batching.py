"""The exact greedy cut against one pass over the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableferry.operators import batching

FRAME = len('{"seq":,"rows":[]}')


def one_pass(sizes, row_limit, budget):
    out, number, rows, used = [], 1, 0, 0
    for size in sizes:
        if rows and (rows == row_limit or FRAME + len(str(number)) + used + size + rows > budget):
            number, rows, used = number + 1, 0, 0
        rows, used = rows + 1, used + size
        out.append((number, rows))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, "x" * rng.choice([0, 1, 5, 40, 40, 90, 300])) for i in range(n)]


@pytest.mark.parametrize("row_limit,budget", [(7, 400), (5, 10_000), (50, 200), (1, 100), (3, 1)])
@pytest.mark.parametrize("short,arity", [(3, 256), (1, 2)])
def test_cut_is_the_one_of_a_single_pass(spark, monkeypatch, row_limit, budget, short, arity):
    monkeypatch.setattr(batching, "SHORT_DIGITS", short)
    monkeypatch.setattr(batching, "ARITY", arity)
    rows = texts(row_limit, 260)
    df = spark.createDataFrame(rows, "id int, v string")
    cut = batching.greedy_batches(df, [F.col("id")], F.array("v"), row_limit, budget, partitions=4, unique=True)
    found = sorted((r["id"], r["row_bytes"], r["batch_no"], r["row_no"]) for r in cut.collect())
    sizes = [len(v) + 4 for _, v in rows]
    assert found == [(i, size, *place) for (i, _), size, place in zip(rows, sizes, one_pass(sizes, row_limit, budget))]


def test_partitions_do_not_change_the_cut(spark):
    df = spark.createDataFrame(texts(1, 300), "id int, v string")
    cuts = [
        sorted(map(tuple, batching.greedy_batches(df, [F.col("id").desc()], None, 20, 900, partitions=n, unique=True).collect())) for n in (1, 7, 64)
    ]
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) == 300


def test_no_rows_no_batches(spark):
    df = spark.createDataFrame([], "id int, v string")
    assert batching.greedy_batches(df, [F.col("id")]).count() == 0


def test_maps_follow_the_pointers():
    rng = random.Random(2)
    for _ in range(200):
        limit = rng.randint(1, 9)
        sizes, ahead = (np.array([rng.randint(1, 60) for _ in range(limit)], np.int64) for _ in range(2))
        following = batching.successors(sizes, ahead, FRAME + 2, limit, rng.randint(1, 200))
        entries, counts = batching.block_map(following, limit)
        for start in range(limit):
            at, n = start, 0
            while at < limit:
                at, n = int(following[at]), n + 1
            assert (entries[start], counts[start]) == (at - limit, n)
        assert (entries[limit], counts[limit]) == (0, 0)
