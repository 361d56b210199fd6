"""SimHash near-duplicates found by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most d bits differ in at
most d // segments bits in one of them, so every fingerprint looks up the small Hamming ball
around each of its segments in a table of all segments, and the complete distance of what it finds
is verified. Equal fingerprints are one entry, and a pair that differs within the segment is looked
up from one side only: the one in which the lowest differing bit is clear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.llm.tables import components, fresh, kept, named, steps, utf8

# Fixed value: the seed of the shingle hashes.
SEED = 42
SHINGLES_AT_ONCE = 1 << 16


def simhash(text: bytes, shingle: int) -> int:
    """Signed 64-bit fingerprint of the word shingles of one UTF-8 text; zero without words.

    Words are what ASCII white space separates, A-Z in lower case. A text of fewer words than a
    shingle is one shingle. A bit is set if it is set in over half the shingle hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [n - 1 for n in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(n + 1 for n in ends[: max(0, len(ends) - shingle)])]
    digest, seed = xxhash.xxh64_intdigest, SEED
    stops = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), SHINGLES_AT_ONCE):
        span = zip(starts[i : i + SHINGLES_AT_ONCE], stops[i : i + SHINGLES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], seed) for a, b in span], np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; a null text counts as empty and has fingerprint zero."""
    source = named(docs, doc_id=id_col, text=text_col)
    source = source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            fp = pa.array([simhash(t, shingle) for t in utf8(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], ["doc_id", "text_hash", "fp"])

    schema = T.StructType([*source.schema.fields[:2], T.StructField("fp", T.LongType())])
    return source.mapInArrow(run, schema)


def _long(bits: int) -> Column:
    return F.lit(bits if bits < 1 << 63 else bits - (1 << 64))


def _ball(segment: int, value: Column, bits: int, radius: int) -> Column:
    """Lookups of one segment: all values within `radius` bits whose lowest differing bit is clear here."""
    flips = [sum(1 << p for p in c) for n in range(radius + 1) for c in combinations(range(bits), n)]
    ball = F.array(*[F.struct(_long(m).alias("bits"), _long(m & -m).alias("lowest")) for m in flips])
    from_here = F.filter(ball, lambda m: value.bitwiseAND(m["lowest"]) == 0)
    return F.transform(
        from_here,
        lambda m: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(m["bits"]).alias("val"), (m["bits"] == 0).alias("same")),
    )


def links(prints: DataFrame, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """Every pair (a, b), a < b, of distinct values of `fp` that differ in at most `max_bits` bits."""
    width = 64 // segments
    widths = [width] * (segments - 1) + [64 - width * (segments - 1)]
    table, probes = [], []
    for s, bits in enumerate(widths):
        value = F.shiftrightunsigned("fp", s * width)
        if bits < 64:
            value = value.bitwiseAND(F.lit((1 << bits) - 1))
        table.append(F.struct(F.lit(s).alias("seg"), value.alias("val")))
        probes.append(_ball(s, value, bits, max_bits // segments))
    entries = prints.select(F.col("fp").alias("b"), F.inline(F.array(*table)))
    lookups = prints.select(F.col("fp").alias("a"), F.inline(F.concat(*probes)))
    found = lookups.join(entries, ["seg", "val"]).filter(
        (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (~F.col("same") | (F.col("a") < F.col("b")))
    )
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 3,
    segments: int = 2,
) -> DataFrame:
    """(doc_id, text_hash, fp, centre, component_id) of every row.

    `centre` is the smallest fingerprint of the component, `component_id` the smallest doc_id in it.
    Rows without words have fingerprint zero and are linked like any other. Repeated rows and equal
    texts share a fingerprint. A row whose id is null belongs to its component but never names it; a
    component of such rows only has a null component_id. An empty table gives an empty result.
    """
    prints = kept(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = components(links(distinct.select("fp"), max_bits, segments))
    named_by = distinct.join(of, distinct.fp == of.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("centre"), "least"
    )
    least = named_by.groupBy("centre").agg(F.min("least").alias("component_id"))
    classes = named_by.join(least, "centre").select("fp", "centre", "component_id")
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "centre", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row of every component, with all columns of `docs`: the one with the smallest id.

    A row with a null id stays only if its component has no other. Among rows that share the id, the
    one with the smallest text hash stays; of rows equal in id and text, the one whose columns have
    the smallest hash.

    What moves are ids and hashes: the list of rows to drop meets the documents where they are, and
    only the texts of rows repeated in id and text are gathered.
    """
    rows = groups(docs, id_col, text_col, **options).groupBy("centre", "component_id", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.filter(own)
    least = first.groupBy("centre").agg(F.min("text_hash").alias("least"))
    repeated = first.join(least, "centre").filter("text_hash > least OR copies > 1").selectExpr("doc_id", "text_hash", "text_hash > least goes")
    marks = kept(rows.filter(~own).selectExpr("doc_id", "text_hash", "true goes").unionByName(repeated), "dropped")
    mark, row_hash, goes = (fresh(docs, name) for name in ("text_hash", "row_hash", "goes"))
    listed = marks.select(F.col("doc_id").alias(fresh(docs, "listed_id")), F.col("text_hash").alias(fresh(docs, "listed_hash")), F.col("goes").alias(goes))
    marked = docs.withColumn(mark, F.xxhash64(docs[f"`{text_col}`"]))
    same = marked[f"`{id_col}`"].eqNullSafe(listed[listed.columns[0]]) & (marked[mark] == listed[listed.columns[1]])
    plain = marked.join(listed, same, "left_anti").drop(mark)
    whole = F.struct(*[marked[f"`{c}`"] for c in docs.columns])
    again = marked.join(listed.filter(~F.col(goes)), same, "left_semi").select(
        marked[f"`{id_col}`"].alias("id"), marked[mark].alias("hash"), whole.alias("whole"), F.xxhash64(whole).alias(row_hash)
    )
    one = again.groupBy("id", "hash").agg(F.min_by("whole", row_hash).alias("whole"))
    return plain.unionByName(one.select(*[F.col("whole")[c].alias(c) for c in docs.columns]))
