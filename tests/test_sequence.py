"""The sequence gate: intervals against plain sets, bounded state, repeated numbers and epochs."""

import random

import numpy as np

from tableferry.streaming import epochs, sequence


def plain(numbers):
    """(expected, got) rows and the number of intervals of a set."""
    held = sorted(set(numbers))
    starts = [n for n in held if n - 1 not in held]
    following = next(n for n in range(1, len(held) + 2) if n not in held)
    jumps = [(max([m for m in held if m < s], default=0) + 1, s) for s in starts if s != 1]
    return sorted([(following, None), *jumps], key=repr), len(starts)


def test_intervals_match_sets():
    rng = random.Random(4)
    for _ in range(300):
        starts = stops = np.zeros(0, np.int64)
        held = set()
        for _ in range(rng.randint(1, 6)):
            new = [rng.randint(1, 40) for _ in range(rng.randint(0, 12))]
            held |= set(new)
            starts, stops = sequence.with_numbers(starts, stops, np.array(new, np.int64))
            rows, intervals = plain(held)
            assert sorted(sequence.refusals(starts, stops), key=repr) == rows and len(starts) == intervals


def test_state_is_bounded_by_the_gaps():
    rng = random.Random(5)
    numbers = [n for n in range(1, 20_001) if n not in (7, 5_000, 12_345)]
    starts = stops = np.zeros(0, np.int64)
    for first in range(0, 20_000, 1_000):
        # Each delivery in any order: the state afterwards has one interval more than gaps.
        piece = [n for n in numbers if first < n <= first + 1_000]
        rng.shuffle(piece)
        starts, stops = sequence.with_numbers(starts, stops, np.array(piece, np.int64))
        assert len(starts) <= 4
    assert len(starts) == 4 and stops[-1] == 20_000


def test_gate_over_several_deliveries(spark, tmp_path):
    schema = "run_id string, batch_no bigint"
    deliveries = [
        [("a", 1), ("a", 2), ("a", 5), ("b", 2), ("a", 5), (None, 1), ("a", 0)],
        [("a", 4), ("a", 2), ("c", 1)],
        [("a", 3), ("b", 1), ("b", 9)],
        [("a", 3)],
    ]
    held = {}
    for rows in deliveries:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/sent")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/sent")
        sequence.start_gate(stream, f"{tmp_path}/gate", f"{tmp_path}/checkpoint").awaitTermination()
        for run, n in rows:
            if run and n > 0:
                held.setdefault(run, set()).add(n)
        found = {}
        for r in sequence.gate_state(spark, f"{tmp_path}/gate").collect():
            found.setdefault(r["run_id"], []).append((r["expected"], r["got"]))
            assert r["intervals"] == plain(held[r["run_id"]])[1]
        assert {run: sorted(x, key=repr) for run, x in found.items()} == {run: plain(x)[0] for run, x in held.items()}
    assert sequence.gate_state(spark, f"{tmp_path}/none").count() == 0


def test_gate_folds_its_epochs_and_starts_over(spark, tmp_path):
    """Seven micro-batches are folded two at a time; a query with a new checkpoint that is behind hides nothing."""
    schema = "run_id string, batch_no bigint"
    numbers = [1, 3, 2, 7, 9, 4, 5]

    def send(folder, n):
        spark.createDataFrame([("a", n), ("b", n + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")

    def follow(folder, checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{folder}")
        sequence.start_gate(stream, f"{tmp_path}/gate", f"{tmp_path}/{checkpoint}", fan=2).awaitTermination()
        found = {}
        for r in sequence.gate_state(spark, f"{tmp_path}/gate").collect():
            found.setdefault(r["run_id"], []).append((r["expected"], r["got"]))
        return {run: sorted(x, key=repr) for run, x in found.items()}

    for n in numbers:
        send("sent", n)
    whole = {"a": plain(numbers)[0], "b": plain([n + 1 for n in numbers])[0]}
    assert follow("sent", "first") == whole
    names = [p.name for p in epochs.uncovered(epochs.EpochFolders(f"{tmp_path}/gate").pieces(spark))]
    assert len(names) == 3 and sum(n.startswith("fold=") for n in names) == 2
    send("again", 1)
    assert follow("again", "second") == whole
    for n in numbers[1:] + [6]:
        send("again", n)
    more = numbers + [6]
    assert follow("again", "second") == {"a": plain(more)[0], "b": plain([n + 1 for n in more])[0]}


def test_gate_joins_blocks_and_bounds_each_state(spark, tmp_path):
    """One run over several blocks, in two deliveries: no written row outgrows its block, and intervals go on where blocks meet."""
    schema, block = "run_id string, batch_no bigint", sequence.BLOCK
    numbers = {*range(1, 40), *range(block - 5, block + 6), *range(2 * block + 1, 2 * block + 4), *range(5 * block - 2, 5 * block + 1)}
    late = {*range(40, block - 5), 2 * block, 5 * block + 2}
    held = set()
    for part in (numbers, late):
        held |= part
        spark.createDataFrame([(run, n) for run in "ab" for n in part if run == "a" or n > 2], schema).write.mode("append").parquet(f"{tmp_path}/sent")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/sent")
        sequence.start_gate(stream, f"{tmp_path}/gate", f"{tmp_path}/checkpoint").awaitTermination()
        found = {}
        for r in sequence.gate_state(spark, f"{tmp_path}/gate").collect():
            found.setdefault((r["run_id"], r["intervals"]), []).append((r["expected"], r["got"]))
        starts, stops = sequence.with_numbers(np.zeros(0, np.int64), np.zeros(0, np.int64), np.array(sorted(held)))
        whole = sorted(sequence.refusals(starts, stops), key=repr)
        starts[0] = 3
        behind = sorted(sequence.refusals(starts, stops), key=repr)
        assert {key: sorted(x, key=repr) for key, x in found.items()} == {("a", len(starts)): whole, ("b", len(starts)): behind}
    rows = epochs.EpochFolders(f"{tmp_path}/gate").read(spark).collect()
    assert len({(r["run_id"], r["block"]) for r in rows}) == 2 * 6 - 2 and all(r["received"] <= block for r in rows)
    assert all((min(r["starts"]) - 1) // block == (max(r["stops"]) - 1) // block == r["block"] for r in rows)
