"""Near-duplicates by word shingles, found by a MinHash LSH forest.

Every distinct set of shingles gets labels, one an order of the forest: the first minima of its
hashes under that order's hash functions. Sorted by label, sets with a common prefix lie side by
side; a run of equal prefixes is a region, and its members are candidates. Where a region has many
members of several components, it is compared block against block, and only links that join
components leave a task. The prefix is adapted to each region: members of a region of too many
blocks go on to a level of deeper prefixes and more orders. At each level there are so many orders
that a pair of the least likeness shares no prefix with a chance of less than one in a million.
Candidates whose first level's minima agree too seldom for such a pair, by the same chance, go; the
others are confirmed on their full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.llm.tables import components, kept, named, steps, utf8

#: Prefix lengths of the levels; chance with which a pair may share no prefix; members up to which
#: all pairs of a region are candidates; members of one block of a region that stays crowded.
DEPTHS, MISS, CROWD, BLOCK = (4, 8, 16), 1e-6, 32, 1024
#: Blocks of members up to which a crowded region needs no deeper level; bytes of the sets of one block.
BLOCKS, BLOCK_BYTES = 4, 32 << 20
#: Hash values of one step of the minima.
HASHES_AT_ONCE = 1 << 18


def orders_needed(percent: int, depth: int) -> int:
    """Orders after which a pair of the least likeness has missed a common prefix with chance MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** depth)))


def agreements_needed(percent: int, minima: int) -> int:
    """Equal minima below which a pair of the least likeness stays with chance MISS at most."""
    p, below = percent / 100, 0.0
    for equal in range(minima + 1):
        below += math.comb(minima, equal) * p**equal * (1 - p) ** (minima - equal)
        if below > MISS:
            return equal
    return minima


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z in lower case.

    Words are what ASCII white space separates. A text of fewer words is one shingle, one without
    words has none.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(found) < words:
        return np.array([digest(b" ".join(found))], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found])[: len(found) - words + 1].tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def labels(shingles: np.ndarray, depth: int, orders: int) -> np.ndarray:
    """An `orders` by `depth` table of 16-bit minima; the functions of a level differ from those of any other."""
    seeds = _mixed(_mixed(np.arange(1, depth * orders + 1, dtype=np.uint64) + np.uint64(depth << 32)))
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    piece = max(1, HASHES_AT_ONCE // len(seeds))
    for i in range(0, len(shingles), piece):
        np.minimum(least, _mixed(shingles[i : i + piece] ^ seeds[:, None]).min(axis=1), out=least)
    return _mixed(least).astype(np.uint16).reshape(orders, depth)


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _prints(docs: DataFrame, words: int, depth: int, orders: int) -> DataFrame:
    """(doc_id, text_hash, key, n, labels) of every row; equal sets share a key, rows without words have none."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = [shingle_set(t, words) for t in utf8(batch)]
            keys = pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary())
            found = pa.array([labels(s, depth, orders).tobytes() if len(s) else None for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), keys, sizes, found], ["doc_id", "text_hash", "key", "n", "labels"]
            )

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(run, f"doc_id {id_type}, text_hash bigint, key binary, n bigint, labels binary")


def _deeper(sets: DataFrame, depth: int, orders: int) -> DataFrame:
    """Entries (ord, label, key, n) of sets (key, shingles), labelled once; the work is dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, packed in zip(batch.column("key").to_pylist(), batch.column("shingles").to_pylist()):
                shingles = np.frombuffer(packed, np.uint64)
                found = [row.tobytes() for row in labels(shingles, depth, orders)]
                columns = [pa.array(range(orders), pa.int32()), pa.array(found, pa.binary()), pa.array([key] * orders, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(shingles)] * orders, pa.int64())], ["ord", "label", "key", "n"])

    dealt = sets.select("key", "shingles").repartition("key")
    return kept(dealt.mapInArrow(run, "ord int, label binary, key binary, n bigint"), "entries")


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (ord, label, key, n) those with a neighbour of the same label, each with the row before it in its run.

    The first and the last row of a range always stay: their run may go on in the next range.
    """

    def decided(table: pa.Table, first: int, stop: int, start: bool, end: bool) -> Iterator[pa.RecordBatch]:
        order, label = table.column("ord").to_numpy(), table.column("label").combine_chunks()
        same = np.zeros(table.num_rows, bool)
        same[1:] = (order[1:] == order[:-1]) & pa.compute.equal(label[1:], label[:-1]).to_numpy(zero_copy_only=False)
        stays = same.copy()
        stays[:-1] |= same[1:]
        stays[0] |= start
        stays[-1] |= end
        places = np.flatnonzero(stays[first:stop]) + first
        before = pa.array(np.maximum(places - 1, 0), mask=~same[places])
        found = table.take(pa.array(places))
        prev = table.select(["key", "n"]).take(before)
        out = pa.table([*found.columns, *prev.columns], names=["ord", "label", "key", "n", "prev", "prev_n"])
        yield from out.combine_chunks().to_batches()

    held, done, start = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        rows = table.num_rows
        if rows > 1:
            yield from decided(table, done, rows - 1, start, False)
            start, done = False, 1
        held = table.slice(max(0, rows - 2))
    if held is not None:
        yield from decided(held, done, held.num_rows, start, True)


def _entries(classes: DataFrame, depth: int, orders: int) -> DataFrame:
    """Entries (ord, label, key, n) of classes with labels."""
    width = 2 * depth
    return classes.select("key", "n", "labels", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("ord")).select(
        "ord", F.substring("labels", F.col("ord") * width + 1, F.lit(width)).alias("label"), "key", "n"
    )


def _neighbours(entries: DataFrame) -> DataFrame:
    """Members (ord, label, key, n, prev, prev_n) of the regions: the rows of every sorted order that share a label.

    In a region, rows are in another pseudo-random order in each order of the forest.
    """
    order = [F.col("ord"), F.col("label"), F.xxhash64("key", "ord")]
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_side_by_side, "ord int, label binary, key binary, n bigint, prev binary, prev_n bigint")


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int, minima: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose first labels agree often enough."""
    least = agreements_needed(percent, minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, minima) for c in ("a_labels", "b_labels")
            )
            likely = (left == right).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(likely))

    left = classes.select(F.col("key").alias("a"), F.col("labels").alias("a_labels"))
    right = classes.select(F.col("key").alias("b"), F.col("labels").alias("b_labels"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_labels", "b_labels").mapInArrow(run, "a binary, b binary")


#: Bits of the filter of text hashes that decides which rows' sets are built again: 8 MB at any size of the tables.
FILTER_BITS = 26


def _read_again(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of the rows (doc_id, text_hash) in `wanted`, each key once.

    Texts stay where they are read: a filter of fixed size over the text hashes picks rows, and
    only the sets of these move, to meet the exact list.
    """
    bit = F.col("text_hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    marks = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    ).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[marks.column("word").to_numpy()] = marks.column("bits").to_numpy()
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            bits = whole.column("text_hash").to_numpy() & ((1 << FILTER_BITS) - 1)
            listed = (table[bits >> 6] >> (bits & 63)) & 1
            for batch in steps(iter([whole.filter(pa.array(listed.astype(bool)))])):
                sets = [shingle_set(t, words) for t in utf8(batch)]
                keys = [_set_key(x) if len(x) else None for x in sets]
                columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "text_hash", "key", "shingles"])

    found = source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {id_type}, text_hash bigint, key binary, shingles binary"
    )
    same = found["doc_id"].eqNullSafe(wanted["doc_id"]) & (found["text_hash"] == wanted["text_hash"])
    exact = found.filter("key IS NOT NULL").join(wanted, same, "left_semi")
    return exact.groupBy("key").agg(F.any_value("shingles").alias("shingles"))


def _alike(percent: int):
    """Sets of these sizes can be alike."""
    return F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")


def _pairs_of(region):
    """All pairs of a region of bounded size."""
    return F.flatten(
        F.transform(
            region,
            lambda x: F.transform(
                F.filter(region, lambda y: x["key"] < y["key"]),
                lambda y: F.struct(x["key"].alias("a"), x["n"].alias("a_n"), y["key"].alias("b"), y["n"].alias("b_n")),
            ),
        )
    )


def _candidates(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n): all of small regions, and neighbours in crowded ones."""
    small = members.join(sizes.filter(f"members BETWEEN 2 AND {CROWD}"), ["ord", "label"])
    regions = small.groupBy("ord", "label").agg(F.collect_list(F.struct("key", "n")).alias("region"))
    pairs = regions.select(F.inline(_pairs_of(F.col("region"))))
    crowded = members.join(sizes.filter(f"members > {CROWD}").select("ord", "label"), ["ord", "label"], "left_semi")
    beside = crowded.filter("prev IS NOT NULL").selectExpr(
        "least(key, prev) a", "if(key < prev, n, prev_n) a_n", "greatest(key, prev) b", "if(key < prev, prev_n, n) b_n"
    )
    return pairs.unionByName(beside)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for left, right in zip(*(batch.column(c).to_pylist() for c in ("a_set", "b_set"))):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(links, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("b_set"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary")


def _likely_rows(table: pa.Table, root: np.ndarray, percent: int, orders: int, first: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a block, each with those rows of the block it meets that are of another component and can be alike.

    `root` has the rows' components and may change meanwhile. On the first level a pair is left to the first
    region it shares: there it is compared too, or goes on to the next level.
    """
    block, n = table.column("block").to_numpy(), table.column("n").to_numpy()
    i, j, order = (table.column(c)[0].as_py() for c in ("i", "j", "ord"))
    found = np.frombuffer(b"".join(table.column("labels").to_pylist()), np.uint16).reshape(table.num_rows, orders, -1)
    least = agreements_needed(percent, found[0].size)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for place, a in enumerate(left.tolist()):
        rest = right[place + 1 :] if i == j else right
        rest = rest[(root[rest] != root[a]) & (100 * np.minimum(n[rest], n[a]) >= percent * np.maximum(n[rest], n[a]))]
        same = found[rest] == found[a]
        likely = same.sum(axis=(1, 2)) >= least
        if first:
            likely &= ~same[:, :order].all(axis=2).any(axis=1)
        if likely.any():
            yield a, rest[likely]


def _components_of(table: pa.Table) -> np.ndarray:
    return table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy().copy()


def _across(members: DataFrame, regions: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, orders: int, first: bool) -> DataFrame:
    """Links (a, b) that join the components in crowded regions, block against block.

    A task gets two blocks of a region and looks at all their likely pairs; of the links it finds, those
    within a component that earlier ones have joined stay out, so it makes fewer rows than it reads. Sets
    go only where their minima leave them a likely pair.
    """

    def likely(table: pa.Table) -> pa.Table:
        stays = np.zeros(table.num_rows, bool)
        for a, rest in _likely_rows(table, _components_of(table), percent, orders, first):
            stays[a] = stays[rest] = True
        return table.filter(pa.array(stays))

    def linked(table: pa.Table) -> pa.Table:
        root, n, links = _components_of(table), table.column("n").to_numpy(), []
        _, ids = np.unique(np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64), return_inverse=True)
        each = np.split(ids, np.cumsum(n)[:-1])
        marked = np.zeros(len(ids), np.int64)
        for a, rest in _likely_rows(table, root, percent, orders, first):
            marked[each[a]] = 1
            starts = np.cumsum(n[rest]) - n[rest]
            both = np.add.reduceat(marked[np.concatenate([each[b] for b in rest])], starts)
            marked[each[a]] = 0
            for b in rest[100 * both >= percent * (n[a] + n[rest] - both)].tolist():
                if root[a] != root[b]:
                    links.append((a, b))
                    root[root == root[b]] = root[a]
        keys = table.column("key").combine_chunks()
        return pa.table({c: keys.take(pa.array([x[k] for x in links], pa.int64())) for k, c in enumerate("ab")})

    parts = f"greatest((members + {BLOCK - 1}) div {BLOCK}, (8 * held + {BLOCK_BYTES - 1}) div {BLOCK_BYTES})"
    rows = members.join(regions.selectExpr("ord", "label", f"cast({parts} as int) blocks"), ["ord", "label"])
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    rows = rows.withColumn("other", F.expr("explode(sequence(0, blocks - 1))")).join(classes.select("key", "labels"), "key")
    rows = rows.selectExpr("ord", "label", "least(block, other) i", "greatest(block, other) j", "block", "key", "n", "comp", "labels")
    place = ["ord", "label", "i", "j"]
    needed = rows.groupBy(*place).applyInArrow(likely, rows.schema)
    return needed.join(sets, "key").groupBy(*place).applyInArrow(linked, "a binary, b binary")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows are linked when 100 times the common shingles are at least `percent` times all shingles of
    both. `component_id` is the smallest id that links lead to, the own one included; `kept` marks
    the row that has it. Null, empty and blank texts have no shingles and are linked with nothing.
    Repeated rows and equal sets are one entry of the forest and always linked. Rows with a null id
    belong to their component but never name it; without another its id is null, and `kept` false.

    Links within a component that is known already aren't looked for; in regions of more than CROWD
    sets in several components all likely pairs across these are compared in blocks. Those of more
    than BLOCKS blocks of sets go on to the next level first, but past the last level are compared
    at any size, so no crowd is cut short.
    """
    source = named(docs, doc_id=id_col, text=text_col)
    first_orders = orders_needed(percent, DEPTHS[0])
    prints = kept(_prints(source, words, DEPTHS[0], first_orders), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = prints.filter("key IS NOT NULL").groupBy("key").agg(
        F.min(first).alias("first"), F.any_value("n").alias("n"), F.any_value("labels").alias("labels"), F.count("*").alias("copies")
    )
    classes = kept(classes.select("key", "first.doc_id", "first.text_hash", "n", "labels", "copies"), "classes")
    minima = DEPTHS[0] * first_orders
    entries, sets, comps = _entries(classes, DEPTHS[0], first_orders), None, None

    def likely(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) that can be alike and lie in different components."""
        pairs = pairs.filter(_alike(percent)).select("a", "b").distinct()
        return kept(_agreeing(pairs if comps is None else _apart(pairs, comps), classes, percent, minima), "pairs")

    def joined(links: DataFrame) -> DataFrame:
        """The components with these links added."""
        stars = links if comps is None else links.unionByName(comps.selectExpr("node a", "component b"))
        return kept(components(stars), "components")

    for depth in DEPTHS:
        members = kept(_neighbours(entries), "members")
        sizes = members.groupBy("ord", "label").agg(F.count("*").alias("members")).filter("members > 1")
        pairs = likely(_candidates(members, sizes))
        if sets is None:
            crowd = members.join(sizes.filter(f"members > {CROWD}"), ["ord", "label"], "left_semi").select("key")
            needed = crowd.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
            wanted = kept(classes.join(needed, "key", "left_semi").select("doc_id", "text_hash"), "wanted")
            sets = kept(_read_again(source, wanted, words), "sets")
        comps = joined(kept(_confirmed(pairs, sets, percent), "links"))
        placed = members.join(comps.withColumnsRenamed({"node": "key", "component": "comp"}), "key", "left")
        placed = placed.withColumn("comp", F.coalesce("comp", "key"))
        regions = placed.groupBy("ord", "label").agg(
            F.count("*").alias("members"), F.sum("n").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high")
        )
        crowded = kept(regions.filter(f"members > {CROWD} AND low < high").select("ord", "label", "members", "held"), "crowded")
        if crowded.isEmpty():
            break
        last = depth == DEPTHS[-1]
        here = crowded if last else crowded.filter(f"members <= {BLOCKS * BLOCK}")
        comps = joined(kept(_across(placed, here, classes, sets, percent, first_orders, depth == DEPTHS[0]), "links"))
        larger = crowded.filter(f"members > {BLOCKS * BLOCK}")
        if last or larger.isEmpty():
            break
        keys = placed.join(larger, ["ord", "label"], "left_semi").select("key").distinct()
        deeper = DEPTHS[DEPTHS.index(depth) + 1]
        entries = _deeper(sets.join(keys, "key", "left_semi"), deeper, orders_needed(percent, deeper))
    placed = classes.join(comps, classes.key == comps.node, "left").select("key", "doc_id", F.coalesce("component", "key").alias("centre"), "copies", F.col("node").isNotNull().alias("linked"))
    least = placed.groupBy("centre").agg(F.min("doc_id").alias("component_id"))
    shared = placed.filter("linked OR copies > 1").join(least, "centre").select("key", "component_id", F.lit(True).alias("shared"))
    out = prints.join(shared, "key", "left")
    component = F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of different components."""
    left = comps.select(F.col("node").alias("a"), F.col("component").alias("a_comp"))
    right = comps.select(F.col("node").alias("b"), F.col("component").alias("b_comp"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.filter("coalesce(a_comp, a) <> coalesce(b_comp, b)").select("a", "b")
