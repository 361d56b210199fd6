"""Value comparison located by digests: only the key ranges whose digests differ are joined.

Both sides are cut into nodes of one width, a power of two of key positions, and each node has a count and a digest
of its rows. Nodes that agree are settled by their count. Those that differ are cut finer, reading nothing but them, until
few rows are left or cutting no longer helps; only the rows left are shuffled and compared value by value.

The position of a row is its distance from the least key where the key is one integer column, so that the nodes left
become ranges which a scan can skip files and row groups by; for any other key it is a hash of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.operators import verify

#: Hash positions have this many bits.
HASH_BITS = 63
#: Ranges a scan is asked to skip by; closer ones are merged, and the nodes themselves decide.
SCAN_RANGES = 64


@dataclass
class Located:
    """What the descent found: rows settled by digest, and where the others lie."""

    first: int | None
    shift: int
    settled: int = 0
    nodes: list[int] = field(default_factory=list)
    levels: list[tuple[int, int, int]] = field(default_factory=list)  # shift, nodes read, nodes that differ

    def ranges(self, most: int = SCAN_RANGES) -> list[tuple[int, int]]:
        """Key ranges, end exclusive, that hold all nodes left: at most `most`, over the smallest gaps."""
        if self.first is None:
            return []
        joined: list[list[int]] = []
        for node in sorted(self.nodes):
            if joined and joined[-1][1] == node:
                joined[-1][1] = node + 1
            else:
                joined.append([node, node + 1])
        if len(joined) > most:
            gaps = sorted(range(1, len(joined)), key=lambda k: joined[k - 1][1] - joined[k][0])
            cuts = [0, *sorted(gaps[: most - 1]), len(joined)]
            joined = [[joined[a][0], joined[b - 1][1]] for a, b in zip(cuts, cuts[1:])]
        return [(self.first + (a << self.shift), self.first + (b << self.shift)) for a, b in joined]


def _integral(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _cell(name: str, kind: T.DataType) -> Column:
    """A text that differs wherever two values of the type differ."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise TypeError(f"column {name} of type {kind.simpleString()} has no digest")
    value = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    return value.cast("string")


def _position(key: Sequence[str], first: int | None) -> Column:
    """Place of a row, NULL where a key column is; such a row has no partner."""
    whole = F.lit(True)
    for name in key:
        whole = whole & F.col(f"`{name}`").isNotNull()
    if first is None:
        at = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{name}`") for name in key]), 1)
    else:
        at = F.col(f"`{key[0]}`").cast("bigint") - F.lit(first).cast("bigint")
    return F.when(whole, at)


def node_digests(df: DataFrame, key: Sequence[str], first: int | None, shift: int) -> DataFrame:
    """``node, rows, sum_*``: count and digest of the rows of each node; rows without a whole key are in none."""
    cells = F.array(*[_cell(f.name, f.dataType) for f in df.schema.fields])
    words = df.select(F.shiftright(_position(key, first), shift).alias("node"), F.sha2(verify.row_text(cells), 256).alias("h"))
    parts = [F.conv(F.substring("h", at, n), 16, 10).cast("decimal(38,0)") for at, n in verify._WORDS]
    return words.filter("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("rows"), *[F.sum(part).alias(f"sum_{k}") for k, part in enumerate(parts)]
    )


def compared_nodes(source: DataFrame, target: DataFrame, key: Sequence[str], first: int | None, shift: int) -> DataFrame:
    """``node, source_rows, target_rows, same`` of every node that either side has rows in."""
    s, t = (node_digests(df, key, first, shift) for df in (source, target))
    same = F.lit(True)
    for name in s.columns[1:]:
        same = same & s[name].eqNullSafe(t[name])
    return s.join(t, s["node"] == t["node"], "full_outer").select(
        F.coalesce(s["node"], t["node"]).alias("node"),
        F.coalesce(s["rows"], F.lit(0)).alias("source_rows"),
        F.coalesce(t["rows"], F.lit(0)).alias("target_rows"),
        same.alias("same"),
    )


def _aligned(source: DataFrame, target: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns they share, in one order and in the target's types."""
    shared = [*key, *[c for c in target.columns if c in set(source.columns) and c not in set(key)]]
    kinds = {f.name: f.dataType for f in target.schema.fields}
    own = {f.name: f.dataType for f in source.schema.fields}
    cast = [F.col(f"`{c}`") if own[c] == kinds[c] else F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in shared]
    return source.select(*cast), target.select(*[F.col(f"`{c}`") for c in shared])


def _restricted(df: DataFrame, key: Sequence[str], found: Located, nulls: bool) -> DataFrame:
    """The rows of the nodes left, and on demand those without a whole key."""
    inside = F.shiftright(_position(key, found.first), found.shift).isin(found.nodes) if found.nodes else F.lit(False)
    ranges = found.ranges()
    if ranges:
        name, near = F.col(f"`{key[0]}`"), F.lit(False)
        for begin, end in ranges:
            near = near | ((name >= begin) & (name <= end - 1))
        inside = near & inside
    if nulls:
        for name in key:
            inside = inside | F.col(f"`{name}`").isNull()
    return df.filter(inside)


def key_span(source: DataFrame, target: DataFrame, key: Sequence[str]) -> tuple[int, int] | None:
    """Least and greatest key over both sides where it is one integer column; None where positions must be hashes."""
    if len(key) != 1 or not _integral(target.schema[key[0]].dataType):
        return None
    both = source.select(F.col(f"`{key[0]}`").alias("k")).unionAll(target.select(F.col(f"`{key[0]}`").alias("k")))
    low, high = both.agg(F.min("k"), F.max("k")).first()
    return None if low is None or high - low >= 1 << HASH_BITS else (low, high)


def locate(source: DataFrame, target: DataFrame, key: Sequence[str], nodes: int = 4096, row_limit: int = 100_000) -> Located:
    """Descend to the nodes that differ. The driver sees at most about `nodes` numbers of a level.

    A level is the last one when the nodes that differ hold at most `row_limit` rows, or more than half of the rows
    that were read for it, or when a node is a single position.
    """
    source, target = _aligned(source, target, key)
    span = key_span(source, target, key)
    first, bits = (None, HASH_BITS) if span is None else (span[0], (span[1] - span[0]).bit_length())
    fan = max(nodes.bit_length() - 1, 1)
    found = Located(first, max(bits - fan, 0))
    parts = (source, target)
    while True:
        level = compared_nodes(*parts, key, first, found.shift)
        # The rows of the result are those of the nodes that differ, and one more for all that agree.
        rows = level.groupBy(F.when(~F.col("same"), F.col("node")).alias("node")).agg(
            F.count("*").alias("n"), F.sum("source_rows").alias("s"), F.sum("target_rows").alias("t")
        ).collect()
        differ = [r for r in rows if r["node"] is not None]
        equal = [r for r in rows if r["node"] is None]
        read, left = sum(r["s"] + r["t"] for r in rows), sum(r["s"] + r["t"] for r in differ)
        found.settled += sum(r["s"] for r in equal)
        found.nodes = sorted(r["node"] for r in differ)
        found.levels.append((found.shift, sum(r["n"] for r in rows), len(differ)))
        if not found.shift or left <= row_limit or 2 * left > read:
            return found
        parts = tuple(_restricted(df, key, found, False) for df in (source, target))
        finer = max((nodes // len(differ)).bit_length() - 1, 1)
        found = Located(first, max(found.shift - finer, 0), found.settled, [], found.levels)


def reconcile_tree(source: DataFrame, target: DataFrame, key: Sequence[str], nodes: int = 4096, row_limit: int = 100_000) -> DataFrame:
    """The rows of `verify.reconcile`, reached through digests.

    Both sides are scanned once for the digests (their keys once more for the span), and what differs is read
    again. Keys must be unique on both sides (`key_report`). Rows with a NULL in the key have no partner.
    """
    found = locate(source, target, key, nodes, row_limit)
    s, t = (_restricted(df, key, found, True) for df in _aligned(source, target, key))
    return verify.reconcile(s, t, key).withColumn("matched", F.col("matched") + F.lit(found.settled).cast("bigint"))


def differing_ranges(source: DataFrame, target: DataFrame, key: Sequence[str], nodes: int = 4096) -> DataFrame:
    """``first_key, last_key, source_rows, target_rows``: the ranges of one integer key whose digests differ."""
    source, target = _aligned(source, target, key)
    span = key_span(source, target, key)
    if span is None:
        raise ValueError(f"ranges need one integer key column with values, not {list(key)}")
    shift = max((span[1] - span[0]).bit_length() - max(nodes.bit_length() - 1, 1), 0)
    begin = F.shiftleft("node", shift) + F.lit(span[0]).cast("bigint")
    return compared_nodes(source, target, key, span[0], shift).filter(~F.col("same")).select(
        begin.alias("first_key"), (begin + F.lit((1 << shift) - 1).cast("bigint")).alias("last_key"), "source_rows", "target_rows"
    )
