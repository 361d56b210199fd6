"""A Merkle manifest of a table: digest-to-children records, and proofs found by descent from the root.

Every row is a leaf. The leaves of a group, in the order of their ids, form runs of 16 whose joined
digests give the next node, up to one node a group; the groups' nodes form a tree in the same way.
A record holds the children of one digest. A proof descends from the root: the digits of a leaf's
rank choose a child in each record, the children not chosen are collected, and the segments of the
path are reversed at the end, so they read from the leaf upward.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.llm.tables import kept
from tableferry.operators.numbering import number_rows

ARITY = 16
DIGEST_BYTES = 32
#: Positions of a level that share a record; equal digests further apart have records of their own,
#: so a digest that very many nodes have is no single join key.
SHARD = 4096


def field_text(value: Column) -> Column:
    """How a value enters a leaf: `-` for null, else its UTF-8 length, a colon and its text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_text, values)), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _child(children: Column, digit: Column) -> Column:
    return F.substring(children, digit * DIGEST_BYTES + 1, F.lit(DIGEST_BYTES))


def _segment(children: Column, digit: Column) -> Column:
    """The children beside the chosen one."""
    return F.struct(
        F.substring(children, F.lit(1), digit * DIGEST_BYTES).alias("left"),
        F.substring(children, (digit + 1) * DIGEST_BYTES + 1, F.lit(ARITY * DIGEST_BYTES)).alias("right"),
    )


PATH = "array<struct<left: binary, right: binary>>"


def _shard(pos: Column) -> Column:
    return F.floor(pos / SHARD)


def _height(nodes: int) -> int:
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // ARITY), height + 1
    return height


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Written levels above `nodes` (grp, pos, n, digest), where n is the number of nodes of the group in the level."""
    levels = []
    for _ in range(_height(most)):
        runs = nodes.filter("n > 1").groupBy("grp", F.expr(f"pos div {ARITY}").alias("pos"))
        sorted_run = F.sort_array(F.collect_list(F.struct("pos", "digest")))
        joined = F.unhex(F.array_join(F.transform(sorted_run, lambda c: F.hex(c["digest"])), ""))
        level = runs.agg(F.expr(f"(max(n) + {ARITY - 1}) div {ARITY}").alias("n"), joined.alias("children"))
        nodes = kept(level.withColumn("digest", F.unhex(F.sha2(hexed(F.col("children")), 256))), "merkle")
        levels.append(nodes)
    return levels


@dataclass
class Manifest:
    """The tree of a table.

    `leaves` (grp, pos, n, digest and carried columns), `groups` (grp, its value, n, subroot), and the
    written levels of the groups' trees and of the tree over the groups, lowest first; `root` is the
    digest of all, None for an empty table.
    """

    leaves: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None

    def records(self) -> DataFrame:
        """(digest, children): what a store of the manifest holds, each digest once a shard and level."""
        parts = [level.select("digest", _shard(F.col("pos")).alias("shard"), "children") for level in self.top + self.levels]
        if not parts:
            return self.leaves.sparkSession.createDataFrame([], "digest binary, shard bigint, children binary")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.distinct()


def manifest(docs: DataFrame, group: str, order: str, fields: list[str], **carried: Column) -> Manifest:
    """The manifest of `docs`: leaves over `fields`, by `group` and, in it, ascending `order`.

    `carried` columns stay beside the leaves under their given names. Nulls come first in both
    orders. Rows that share group and order value are ordered by leaf digest; equal rows are leaves
    of their own. Null and empty texts are different leaves. An empty table has no root.
    """
    column = {name: docs[f"`{name}`"] for name in {group, order, *fields}}
    leaves = kept(
        docs.select(
            column[group].cast("string").alias("grp_value"),
            column[order].alias("rank_value"),
            leaf_digest(*[column[f] for f in fields]).alias("digest"),
            *[value.alias(name) for name, value in carried.items()],
        ),
        "leaves",
    )
    numbered = number_rows(leaves, [F.col(c).asc() for c in ("grp_value", "rank_value", "digest")], "rn")
    numbered = kept(numbered, "leaves", leaves)
    sizes = numbered.groupBy("grp_value").agg(F.min("rn").alias("first"), F.count("*").alias("n"))
    groups = kept(number_rows(sizes, [F.col("grp_value").asc()], "grp", unique=True), "groups")
    most = groups.agg(F.count("*"), F.max("n")).first()
    same_group = numbered["grp_value"].eqNullSafe(groups["grp_value"])
    placed = numbered.join(groups, same_group).select(
        (F.col("grp") - 1).alias("grp"), (F.col("rn") - F.col("first")).alias("pos"), "n", "digest", *carried
    )
    levels = _levels(placed, most[1] or 0)
    whole = placed.select("grp", "n", "digest")
    for level in levels:
        whole = whole.unionByName(level.select("grp", "n", "digest"))
    subroots = whole.filter("n = 1").select("grp", F.col("digest").alias("subroot"))
    named = groups.select((F.col("grp") - 1).alias("grp"), "grp_value", "n").join(subroots, "grp")
    named = kept(named, "subroots")
    top = _levels(named.selectExpr("0L grp", "grp pos", f"{most[0]}L n", "subroot digest"), most[0])
    root = (top[-1].select("digest") if top else named.select("subroot")).first()
    return Manifest(placed, named, levels, top, None if root is None else bytes(root[0]))


def _descend(frontier: DataFrame, records: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """One step: every node of the frontier opens its record and passes its path to the children.

    With `wanted` (grp, pos) only the children that requests lead through are followed.
    """
    store = records.select("digest", _shard(F.col("pos")).alias("shard"), "children").distinct()
    opened = frontier.withColumn("shard", _shard(F.col("pos"))).join(store, ["digest", "shard"])
    digits = F.sequence(F.lit(0), F.expr(f"cast(octet_length(children) div {DIGEST_BYTES} as int) - 1"))
    others = [c for c in frontier.columns if c not in ("pos", "digest", "path")]
    children = opened.select(*others, "pos", "path", "children", F.explode(digits).alias("digit")).select(
        *others,
        (F.col("pos") * ARITY + F.col("digit")).alias("pos"),
        _child(F.col("children"), F.col("digit")).alias("digest"),
        F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"),
    )
    return children if wanted is None else children.join(wanted, ["grp", "pos"], "left_semi")


def proofs(tree: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The leaves with their carried columns, `subroot`, and `path`: the siblings from the leaf to the root.

    `requests` (grp, pos) names leaves by group number and rank; without it every leaf is asked for.
    A path has one entry a level, the digests left and right of the own one, both empty where a run
    holds one node. A group of one leaf has the leaf as subroot, and no level of its own.
    """
    leaves = tree.leaves if requests is None else tree.leaves.join(requests.select("grp", "pos").distinct(), ["grp", "pos"], "left_semi")
    wanted = None if requests is None else leaves.select("grp", "pos")

    def through(power: int, *names: str) -> DataFrame | None:
        return None if wanted is None else wanted.selectExpr(*names[:1], f"{names[1]} div {ARITY**power} pos").distinct()

    frontier = tree.groups.sparkSession.range(0 if tree.root is None else 1).select(
        F.lit(0).cast("bigint").alias("grp"), F.lit(0).cast("bigint").alias("pos"), F.lit(tree.root).cast("binary").alias("digest"), F.array().cast(PATH).alias("path")
    )
    for power, records in reversed(list(enumerate(tree.top))):
        frontier = _descend(frontier, records, through(power, "0L grp", "grp"))
    roots = frontier.select(F.col("pos").alias("grp"), F.col("digest").alias("subroot"), "path").join(tree.groups.select("grp", "n"), "grp")
    starts = roots.select("grp", "n", "subroot", F.lit(0).cast("bigint").alias("pos"), F.col("subroot").alias("digest"), "path")
    # Groups join the descent at their own height; the last step stops at the runs, whose rows the leaves look up.
    runs = starts.filter("n = 1").select("grp", "pos", "subroot", "path", F.lit(None).cast("binary").alias("children"))
    frontier = None
    for power, records in reversed(list(enumerate(tree.levels))):
        here = starts.filter(f"n > {ARITY**power} AND n <= {ARITY ** (power + 1)}")
        frontier = here if frontier is None else frontier.unionByName(here)
        if power:
            frontier = _descend(frontier, records, through(power, "grp", "pos"))
        else:
            store = records.select("digest", _shard(F.col("pos")).alias("shard"), "children").distinct()
            last = frontier.withColumn("shard", _shard(F.col("pos"))).join(store, ["digest", "shard"])
            runs = runs.unionByName(last.select("grp", "pos", "subroot", "path", "children"))
    asked = leaves.drop("n").withColumn("run", F.expr(f"pos div {ARITY}")).withColumn("digit", (F.col("pos") % ARITY).cast("int"))
    found = asked.join(runs.withColumnRenamed("pos", "run"), ["grp", "run"])
    own = F.when(F.col("children").isNull(), F.array().cast(PATH)).otherwise(F.array(_segment(F.col("children"), F.col("digit"))))
    return found.withColumn("path", F.reverse(F.concat("path", own))).drop("run", "digit", "children")


def path_text(path: Column) -> Column:
    """All siblings of a path as joined hex text."""
    joined = F.aggregate(path, F.lit(b""), lambda text, s: F.concat(text, s["left"], s["right"]))
    return hexed(joined)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings give, as hex text."""
    return F.aggregate(path, hexed(leaf), lambda own, s: F.sha2(F.concat(hexed(s["left"]), own, hexed(s["right"])), 256))
