"""Checks around a copy: counts, batch numbers, digests, value comparison, snapshot difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.operators.numbering import canonical_cells


def verify_gate(counts: DataFrame) -> DataFrame:
    """Add ``verdict, cause`` to rows ``run_id, source_rows, source_batches, staged_rows,
    sink_reported_rows, received_batches``.

    The gate passes when the staged rows equal the source rows and all batches arrived.
    """
    passed = (F.col("staged_rows") == F.col("source_rows")) & (
        F.col("received_batches") == F.col("source_batches")
    )
    lost = (
        (F.col("received_batches") == F.col("source_batches"))
        & (F.col("sink_reported_rows") == F.col("source_rows"))
        & (F.col("staged_rows") < F.col("sink_reported_rows"))
    )
    return counts.select(
        "*",
        F.when(passed, "PASSED").otherwise("VERIFY_FAILED").alias("verdict"),
        F.when(passed, F.lit(None)).when(lost, "LOST_IN_WRITE").otherwise("BATCH_NOT_DELIVERED").alias("cause"),
    )


def batch_contiguity(batches: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each run received exactly the batches 1..N.

    ``batches``: run_id, batch_no (one or many rows per batch); ``expected``: run_id,
    source_batches. A run without batches is contiguous when N is 0.
    """
    seen = (
        batches.groupBy("run_id", "batch_no").agg(F.count("*").alias("rows"))
        .groupBy("run_id")
        .agg(
            F.min("batch_no").alias("first_batch"),
            F.max("batch_no").alias("last_batch"),
            F.count("*").alias("batches"),
            F.sum("rows").alias("rows"),
        )
    )
    n = F.col("source_batches")
    whole = (F.col("first_batch") == 1) & (F.col("last_batch") == n) & (F.col("batches") == n)
    return expected.join(seen, "run_id", "left").select(
        "run_id",
        "source_batches",
        "first_batch",
        "last_batch",
        F.coalesce("batches", F.lit(0)).alias("batches"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("batches").isNull(), n == 0).otherwise(whole).alias("contiguous"),
    )


def row_text(cells: Column) -> Column:
    """One unambiguous text per row: every cell with its length, NULL apart from empty."""
    marked = F.transform(
        cells,
        lambda c: F.when(c.isNull(), "~").otherwise(F.concat(F.char_length(c).cast("string"), F.lit(":"), c)),
    )
    return F.array_join(marked, "")


#: Hexadecimal digits of a row's SHA-256 that make one number: four of 60 bits, one of 16.
_WORDS = ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``rows, hash_sum, hash_xor``: a digest that does not depend on row order.

    Both are over all 256 bits of every row's hash, in five parts. They are summed map-side; the sum also tells
    repeated rows apart, which the exclusive-or alone would cancel.
    """
    hashed = df.select(F.sha2(row_text(canonical_cells(df, columns)), 256).alias("h"))
    words = hashed.select(*[F.conv(F.substring("h", at, n), 16, 10).cast("bigint").alias(f"w{k}") for k, (at, n) in enumerate(_WORDS)])
    names = words.columns
    total = words.agg(
        F.count("*").alias("rows"),
        *[F.coalesce(F.sum(F.col(w).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"sum_{w}") for w in names],
        *[F.coalesce(F.bit_xor(w), F.lit(0)).alias(f"xor_{w}") for w in names],
    )
    joined = [F.concat_ws(":", *[F.col(f"{kind}_{w}").cast("string") for w in names]).alias(f"hash_{kind}") for kind in ("sum", "xor")]
    return total.select("rows", *joined)


def reconcile(source: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Value-by-value comparison by key: one row per shared column.

    Values are compared in the target's type, so decimals are padded to the target scale and
    texts must be equal byte by byte. Keys must be unique on both sides (`key_report`).
    """
    columns = [c for c in target.columns if c in set(source.columns) and c not in set(key)]
    kinds = {f.name: f.dataType for f in target.schema.fields}
    s = source.select(*key, *columns).withColumn("_s", F.lit(True)).alias("s")
    t = target.select(*key, *columns).withColumn("_t", F.lit(True)).alias("t")
    test = F.lit(True)
    for name in key:
        test = test & (F.col(f"s.{name}") == F.col(f"t.{name}"))
    both = F.col("s._s").isNotNull() & F.col("t._t").isNotNull()

    def bytes_of(side: str, name: str) -> Column:
        value = F.col(f"{side}.{name}").cast(kinds[name])
        return value.cast("binary") if isinstance(kinds[name], T.StringType) else value

    counts = [
        F.count_if(both & ~bytes_of("s", c).eqNullSafe(bytes_of("t", c))).alias(f"different_{i}")
        for i, c in enumerate(columns)
    ]
    totals = s.join(t, test, "full_outer").agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("t._t").isNull()).alias("only_in_source"),
        F.count_if(F.col("s._s").isNull()).alias("only_in_target"),
        *counts,
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("matched"),
                F.col(f"different_{i}").alias("different"),
                F.col("only_in_source"),
                F.col("only_in_target"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def snapshot_diff(baseline: DataFrame, attempt: DataFrame) -> DataFrame:
    """One row ``missing_rows, added_rows, symmetric_diff`` between two sets of rows.

    Set semantics: repeated rows count once. Both directions come out of one grouping, whose
    map side already folds copies.
    """
    marked = baseline.withColumn("_side", F.lit(1)).unionByName(attempt.withColumn("_side", F.lit(2)))
    sides = marked.groupBy(*baseline.columns).agg(F.bit_or("_side").alias("_sides"))
    missing, added = F.count_if(F.col("_sides") == 1), F.count_if(F.col("_sides") == 2)
    return sides.agg(
        missing.alias("missing_rows"), added.alias("added_rows"), (missing + added).alias("symmetric_diff")
    )
