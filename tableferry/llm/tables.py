"""What the operations share: inputs under fixed names, written intermediate tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.scratch import write_scratch
from tableferry.sources.files import remove

#: Texts that one step of a Python loop holds at once, in bytes; a longer text is a step by itself.
STEP_BYTES = 8 << 20


def named(df: DataFrame, **columns: str) -> DataFrame:
    """The given columns under the names an operation uses; no other column can clash with them."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def steps(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `most` bytes of text; a longer text is a piece by itself."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        first = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)


def utf8(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as bytes; null counts as empty."""
    column = batch.column(text)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition over columns of equal names in which null equals null."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, though `body` uses it often or in lambdas of its own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kept(df: DataFrame, name: str, *obsolete: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again; written tables it replaces are removed."""
    written = write_scratch(df, name)
    for old in obsolete:
        discard(old)
    return written


def discard(written: DataFrame) -> None:
    """Remove a table that `kept` wrote, once nothing reads it any more."""
    for folder in {path.rpartition("/")[0] for path in written.inputFiles()}:
        remove(written.sparkSession, folder)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node.

    A component is named by its smallest node. Large stars and small stars alternate until nothing
    changes; a round is two joins with minima that are aggregated before they are shuffled, so a
    node with very many neighbours is no task of its own.
    """
    current = kept(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    state = None
    while True:
        marks = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(marks) == state or not marks[0]:
            break
        state = tuple(marks)
        both = current.unionByName(current.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").selectExpr("b a", "m b").filter("a <> b").distinct()
        current = kept(large, "edges", current)
        least = current.groupBy("a").agg(F.min("b").alias("m"))
        joined = current.join(least, "a")
        small = joined.selectExpr("b a", "m b").unionByName(least.selectExpr("a", "m b"))
        current = kept(small.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges", current)
    centres = current.select(F.col("b").alias("node")).distinct()
    return current.selectExpr("a node", "b component").unionByName(centres.selectExpr("node", "node component"))
