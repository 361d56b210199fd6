"""The Merkle manifest against a plain-loop tree, for every leaf, some leaves, changed leaves and odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import CASES, SCHEMA

from tableferry.llm import merkle
from tableferry.llm.queries import QUERIES

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Levels of a tree, lowest first; the last has one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, place):
    """(left, right) siblings, from the lowest level up."""
    out = []
    for level in levels[:-1]:
        run = level[place // 16 * 16 :][:16]
        out.append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        place //= 16
    return out


def brute(rows):
    """(row, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    crown = tree([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for place, (_, _, digest, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            out.append((row, digest, trees[s][-1][0], crown[-1][0], path(trees[s], place) + path(crown, g)))
    return out


def fold(digest, siblings):
    for left, right in siblings:
        digest = h(left, digest, right)
    return digest


def many():
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(600, 0, -1)] + [(7, "hot", "en", 7, "Text 7")] * 40
    rows += [(i, f"s{i % 18}", None, None, None if i % 3 else "") for i in range(1000, 1060)] + [(5000, "lone", "x", 1, "ß ü")]
    return rows


@pytest.mark.parametrize("which", ["cases", "many", "one"])
def test_manifest_matches_plain_tree(spark, which):
    rows = {"cases": [(i, s, lang, None, t) for i, t, lang, s in CASES], "many": many(), "one": [(1, None, None, None, None)]}[which]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    docs = docs.withColumn("grp", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("digest", F.lit(2)).repartition(5)
    found = merkle.manifest(docs, "source", "doc_id", FIELDS, doc_id=F.col("doc_id"), body=F.col("text"))
    proofs = merkle.proofs(found).withColumn("folded", merkle.folded(F.col("digest"), F.col("path")))
    got = sorted(
        (repr(r.doc_id), repr(r.body), r.digest.hex(), r.subroot.hex(), r.folded, repr([(s.left.hex(), s.right.hex()) for s in r.path]))
        for r in proofs.collect()
    )
    expected = brute(rows)
    assert got == sorted((repr(r[0]), repr(r[4]), d, sub, root, repr(p)) for r, d, sub, root, p in expected)
    assert found.root.hex() == expected[0][3] and {fold(d, p) for _, d, _, _, p in expected} == {found.root.hex()}


def test_requested_leaves_and_records(spark):
    docs = spark.createDataFrame(many(), "doc_id bigint, source string, lang string, n_chars bigint, text string")
    found = merkle.manifest(docs, "source", "doc_id", FIELDS, doc_id=F.col("doc_id"))
    wanted = spark.createDataFrame([(0, 0), (0, 17), (0, 639), (3, 1), (0, 17), (99, 5)], "grp bigint, pos bigint")
    some = merkle.proofs(found, wanted).select("grp", "pos", "digest", "path")
    every = merkle.proofs(found).select("grp", "pos", "digest", "path")
    expected = every.filter("(grp = 0 AND pos IN (0, 17, 639)) OR (grp = 3 AND pos = 1)")
    assert sorted(map(repr, some.collect())) == sorted(map(repr, expected.collect())) and some.count() == 4
    for record in found.records().collect():
        assert hashlib.sha256(bytes(record.children).hex().encode()).digest() == bytes(record.digest)


def test_equal_digests_stay_apart_in_shards(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SHARD", 2)
    docs = spark.createDataFrame([(1, "s", "same")] * 300 + [(2, "s", "other")], "doc_id int, source string, text string")
    found = merkle.manifest(docs, "source", "doc_id", ["doc_id", "text"], doc_id=F.col("doc_id"))
    roots = merkle.proofs(found).select(merkle.folded(F.col("digest"), F.col("path")).alias("root"))
    assert roots.count() == 301 and {r.root for r in roots.collect()} == {found.root.hex()}


def test_empty_table_and_query(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    found = merkle.manifest(none, "source", "doc_id", FIELDS, doc_id=F.col("doc_id"))
    assert found.root is None and merkle.proofs(found).count() == 0 and found.records().count() == 0
    spark.createDataFrame(many(), "doc_id bigint, source string, lang string, n_chars bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    for r in rows:
        text = next(t for i, _, _, _, t in many() if i == r.doc_id)
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and (text or "").lower() != (text or "")
        assert r.verified == (not changed) and (r.folded_root == r.root) == r.verified
    assert {r.verified for r in rows} == {True, False}
