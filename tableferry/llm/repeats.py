"""Byte strings of a given length that occur more than once, removed wherever they occur.

Every window of `length` bytes has an anchor: of the shorter strings of CORE bytes in it, the one
with the least hash. Equal windows have equal anchors at the same place, so windows are compared only
where anchors have equal hashes; an anchor stands for all windows around it, the bytes of which are its context. Anchors
of one hash that all have the same context repeat as a whole. Otherwise one copy of each context is sorted as
suffixes from the anchor on, and as reversed prefixes before it, by deep-shallow sorting: multikey
quicksort on the first SHALLOW bytes, then blind tries for the groups that agree so far. A window repeats if another context
shares it on both sides, which the common prefixes of neighbours in the two orders tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.llm.tables import kept, named, steps, utf8

CORE = 200
SHALLOW = 32
#: Bytes that are hashed at once, and bytes of contexts that are sorted at once.
PIECE, SORTED_BYTES = 1 << 20, 8 << 20
DOC = ("doc_id", "text_hash")


class Anchors:
    """Finds the anchors of texts; keeps the powers of its rolling hash."""

    def __init__(self, length: int, core: int):
        self.length, self.core, self.ahead = length, core, length - core + 1
        random = np.random.default_rng(400)
        self.values = random.integers(1 << 63, size=256, dtype=np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 14)
            ones = np.ones(n, np.uint64)
            ones[1:] = self.base
            self.powers = np.multiply.accumulate(ones)
            ones[1:] = self.inverse
            self.inverses = np.multiply.accumulate(ones)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors in order, and the hashes of the strings that start there."""
        places, hashes = [], []
        for first in range(0, max(len(text) - self.length + 1, 0), PIECE):
            at, key = self._piece(np.frombuffer(text, np.uint8, min(PIECE + self.length - 1, len(text) - first), first))
            at += first
            if places and len(places[-1]) and len(at) and places[-1][-1] == at[0]:
                at, key = at[1:], key[1:]
            places.append(at)
            hashes.append(key)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(places), np.concatenate(hashes)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        self._reach(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        key = (sums[self.core :] - sums[: n - self.core + 1]) * self.inverses[: n - self.core + 1]
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
        # The place in the low bits makes the leftmost of equal strings the least.
        low = np.uint64((1 << 21) - 1)
        least = (key & ~low) | np.arange(len(key), dtype=np.uint64)
        width = 1
        while 2 * width <= self.ahead:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < self.ahead:
            more = self.ahead - width
            least = np.minimum(least[:-more], least[more:])
        at = (least & low).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        return at, key[at]


def anchors(docs: DataFrame, id_col: str, text_col: str, length: int, core: int = CORE) -> DataFrame:
    """(doc_id, text_hash, start, at, end, key, c1, c2): anchors, their contexts' bounds and digests."""
    source = named(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType([
        *source.schema.fields[:2], *[T.StructField(c, T.IntegerType()) for c in ("start", "at", "end")],
        *[T.StructField(c, T.LongType()) for c in ("key", "c1", "c2")],
    ])
    before = length - core

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, core)
        for batch in steps(batches):
            rows, ats, starts, ends, keys, digests = [], [], [], [], [], []
            for i, text in enumerate(utf8(batch)):
                at, key = finder.of(text)
                if not len(at):
                    continue
                start, end = np.maximum(at - before, 0), np.minimum(at + length, len(text))
                rows.append(np.full(len(at), i))
                ats.append(at), keys.append(key), starts.append(start), ends.append(end)
                digests += [
                    hashlib.blake2b(text[a:b], digest_size=16, salt=(p - a).to_bytes(8, "little")).digest()
                    for a, b, p in zip(start.tolist(), end.tolist(), at.tolist())
                ]
            if not rows:
                continue
            owner = pa.array(np.concatenate(rows))
            marks = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            bounds = [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ats, ends)]
            key = pa.array(np.concatenate(keys).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), *bounds, key,
                 pa.array(np.ascontiguousarray(marks[:, 0])), pa.array(np.ascontiguousarray(marks[:, 1]))],
                schema.names,
            )

    return source.mapInArrow(run, schema)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_order(strings: list[bytes], members: list[int]) -> list[int]:
    """`members` in the order of their strings, by a blind trie.

    A node is [depth, children by the byte at that depth]; a leaf lists equal strings. An insertion goes down
    by branching bytes alone to some leaf, compares once, and goes in where the path passes the common prefix.
    """

    def byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    root: list | None = None
    for m in members:
        s = strings[m]
        if root is None:
            root = [None, [m]]
            continue
        node = root
        while node[0] is not None:
            children = node[1]
            node = children.get(byte(s, node[0])) or next(iter(children.values()))
        t = strings[node[1][0]]
        shared = _common(s, t)
        if shared == len(s) == len(t):
            node[1].append(m)
            continue
        node = root
        while node[0] is not None and node[0] < shared:
            node = node[1][byte(s, node[0])]
        if node[0] == shared:
            node[1][byte(s, shared)] = [None, [m]]
        else:  # the edge to this node is cut: it takes the place of a new node
            node[:] = [shared, {byte(t, shared): [node[0], node[1]], byte(s, shared): [None, [m]]}]
    order: list[int] = []
    stack = [root] if root else []
    while stack:
        depth, below = stack.pop()
        if depth is None:
            order += below
        else:
            stack += [below[c] for c in sorted(below, reverse=True)]
    return order


def deep_shallow_order(strings: list[bytes]) -> np.ndarray:
    """The order of byte strings: multikey quicksort by eight bytes at a time, blind tries from SHALLOW on."""
    heads = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(len(strings), -1)
    heads = heads.astype(np.uint64)
    order: list[int] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(len(strings)), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            order += members.tolist()
        elif depth == heads.shape[1]:
            order += blind_order(strings, members.tolist())
        else:
            word = heads[members, depth]
            pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
            stack += [(members[word > pivot], depth), (members[word == pivot], depth + 1), (members[word < pivot], depth)]
    return np.array(order, np.int64)


def neighbours(strings: list[bytes], order: np.ndarray) -> np.ndarray:
    """Common prefix of each string with the one before it in the order."""
    common = [_common(strings[a], strings[b]) for a, b in zip(order[:-1].tolist(), order[1:].tolist())]
    return np.array([-1, *common], np.int64)


def repeated_offsets(lefts: list[bytes], rights: list[bytes], copies: np.ndarray, length: int, core: int) -> np.ndarray:
    """For each context and number of bytes before the anchor, whether that window occurs again."""
    n = len(rights)
    by_right = deep_shallow_order(rights)
    right_common = neighbours(rights, by_right)
    cores = np.empty(n, np.int64)
    cores[by_right] = np.cumsum(right_common < core)
    mirrored = [int(c).to_bytes(8, "big") + left[::-1] for c, left in zip(cores, lefts)]
    by_left = deep_shallow_order(mirrored)
    left_common = neighbours(mirrored, by_left) - 8
    left_size, right_size = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    result = np.zeros((n, length - core + 1), bool)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(length - core + 1):
        there = np.flatnonzero((left_size >= before) & (right_size >= length - before))
        if not len(there):
            continue
        left_class[by_left] = np.cumsum(left_common < before)
        right_class[by_right] = np.cumsum(right_common < length - before)
        _, window = np.unique(left_class[there] * (n + 1) + right_class[there], return_inverse=True)
        result[there, before] = np.bincount(window, copies[there])[window] > 1
    return result


def _shared_ranges(contexts: DataFrame, length: int, core: int) -> DataFrame:
    """(key, c1, c2, first, last): stretches relative to the anchor that repeated windows cover.

    All contexts of a key meet in one task, one copy of each; tasks sort a few MB at a time.
    """
    names = ["key", "c1", "c2", "first", "last"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names[:3]] + [T.StructField(c, T.IntegerType()) for c in names[3:]])

    def solve(table: pa.Table) -> pa.RecordBatch:
        contexts, befores = table.column("context").to_pylist(), table.column("before").to_pylist()
        lefts = [c[:b] for c, b in zip(contexts, befores)]
        rights = [c[b:] for c, b in zip(contexts, befores)]
        again = repeated_offsets(lefts, rights, table.column("copies").to_numpy(), length, core)
        edges = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)  # one after the last of each stretch, in the same order
        taken = table.select(names[:3]).combine_chunks().take(pa.array(row))
        bounds = [pa.array(-(high - 1), pa.int32()), pa.array(length - low, pa.int32())]
        return pa.RecordBatch.from_arrays([*[taken.column(c).combine_chunks() for c in names[:3]], *bounds], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            if sum(t.nbytes for t in waiting) < SORTED_BYTES:
                continue
            table = pa.concat_tables(waiting)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last key may go on
            if cut:
                yield solve(table.slice(0, cut))
            waiting = [table.slice(cut)]
        if waiting:
            yield solve(pa.concat_tables(waiting))

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, core: int = CORE) -> DataFrame:
    """(doc_id, text_hash, spans) of the documents with bytes in strings of `length` bytes that start anywhere else too.

    `spans` are (first, last) in bytes of the UTF-8 text, last exclusive; they may overlap. Rows that share id and
    text are places of their own, so each repeats the other. Texts shorter than `length` have no such strings.
    """
    if not 0 < core < length:
        raise ValueError("core must be shorter than length")
    found = kept(anchors(docs, id_col, text_col, length, core), "anchors")
    keys = found.groupBy(F.col("key").alias("k")).agg(
        F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)]
    )
    keys = keys.filter("n > 1").select("k", F.expr("min_c1 = max_c1 AND min_c2 = max_c2").alias("uniform"))
    # Written before the join: neither side then needs a key's rows in one task, so a hot key can be split.
    keys = kept(keys, "keys")
    several = kept(found.join(keys, F.col("key") == F.col("k")).drop("k"), "several")
    whole = several.filter("uniform").select(*DOC, F.col("start").alias("first"), F.col("end").alias("last"))
    mixed = several.filter("NOT uniform")
    place = F.struct(*DOC, "start", "at", "end")
    classes = mixed.groupBy("key", "c1", "c2").agg(F.count("*").alias("copies"), F.min(place).alias("place"))
    classes = classes.select("key", "c1", "c2", "copies", *[F.col(f"place.{c}").alias(f"p_{c}") for c in (*DOC, "start", "at", "end")])
    texts = named(docs, doc_id=id_col, text=text_col)
    here = texts.doc_id.eqNullSafe(F.col("p_doc_id")) & (F.xxhash64("text") == F.col("p_text_hash"))
    context = F.expr("substring(cast(text AS binary), p_start + 1, p_end - p_start)")
    contexts = texts.join(classes, here).select("key", "c1", "c2", "copies", (F.col("p_at") - F.col("p_start")).alias("before"), context.alias("context"))
    contexts = kept(contexts.dropDuplicates(["key", "c1", "c2"]), "contexts")
    ranges = kept(_shared_ranges(contexts, length, core), "ranges")
    parts = mixed.join(ranges, ["key", "c1", "c2"]).select(*DOC, (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))
    spans = whole.unionByName(parts).groupBy(*DOC).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return kept(spans, "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, core: int = CORE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; `kept` are the remaining bytes.

    Every byte in a repeated string goes, also in its first copy; `n_spans` counts the maximal removed runs. A null
    text counts as empty. Bytes that remain need not be valid UTF-8.
    """
    spans = repeated_spans(docs, id_col, text_col, length, core).select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "spans")
    source = named(docs, doc_id=id_col, text=text_col)
    joined = source.join(spans, source.doc_id.eqNullSafe(F.col("s_id")) & (F.xxhash64("text") == F.col("s_hash")), "left")
    joined = joined.select("doc_id", "text", "spans")
    schema = T.StructType([
        joined.schema[0], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for text, found in zip(utf8(batch), batch.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for a, b in sorted((s["first"], s["last"]) for s in found or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                at, left = 0, []
                for a, b in merged:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                rows.append((len(text), sum(b - a for a, b in merged), len(merged), b"".join(left)))
            columns = [pa.array(x, pa.int64()) for x in list(zip(*rows))[:3]] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r[3] for r in rows], pa.binary())], schema.names)

    return joined.mapInArrow(run, schema)
