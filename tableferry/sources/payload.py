"""Batch payloads: one JSON line ``{"seq":N,"rows":[[text or null, ...], ...]}`` per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = "array<struct<seq: bigint, rows: array<array<string>>>>"
# The JSON shapes a payload may have. VOID stands for a list without any text.
PAYLOAD_SHAPES = tuple(
    f"ARRAY<OBJECT<rows: {rows}, seq: BIGINT>>"
    for rows in ("ARRAY<ARRAY<STRING>>", "ARRAY<ARRAY<VOID>>", "ARRAY<VOID>")
)


def write_payloads(batched: DataFrame, cells: Column) -> DataFrame:
    """``batch_no, rows, bytes, payload`` from rows with ``batch_no, row_no``.

    A batch holds at most the row limit and the byte budget, so its list is bounded.
    """
    row = F.struct("row_no", cells.alias("cells"))
    grouped = batched.groupBy("batch_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    payload = F.to_json(
        F.struct(F.col("batch_no").alias("seq"), F.transform("rows", lambda r: r["cells"]).alias("rows"))
    )
    return grouped.select(
        "batch_no", F.size("rows").cast("bigint").alias("rows"), payload.alias("payload")
    ).withColumn("bytes", F.octet_length("payload").cast("bigint"))


def parse_payloads(lines: DataFrame, expected_columns: int, column: str = "value") -> DataFrame:
    """Add ``seq, rows, reason``; `reason` is NULL for an accepted line.

    `from_json` alone would drop unknown fields and turn numbers into texts, so the shape of
    the JSON is checked first: BAD_SHAPE covers broken JSON, other fields, cells that are
    neither text nor null, and a seq that is no whole number. Then every row must be as wide
    as the column list (BAD_WIDTH).

    Spark's JSON readers stop after the first value, so the line is read inside a list, and once
    more inside an object: what follows the value breaks at least one of the two.
    """
    line = F.col(column)
    listed = F.concat(F.lit("["), line, F.lit("]"))
    alone = F.json_object_keys(F.concat(F.lit('{"p":'), line, F.lit("}"))) == F.array(F.lit("p"))
    shape = F.schema_of_variant(F.try_parse_json(listed))
    shaped = F.coalesce(shape.isin(*PAYLOAD_SHAPES) & alone, F.lit(False))
    parsed = F.when(shaped, F.try_element_at(F.from_json(listed, PAYLOAD_SCHEMA), F.lit(1)))
    rows = F.col("_p.rows")
    has_null_row = F.exists(rows, lambda r: r.isNull())
    wrong_width = F.exists(rows, lambda r: F.size(r) != expected_columns)
    reason = (
        F.when(F.col("_p").isNull() | rows.isNull() | (F.col("_p.seq") < 0) | has_null_row, "BAD_SHAPE")
        .when(wrong_width, "BAD_WIDTH")
    )
    return (
        lines.withColumn("_p", parsed)
        .withColumn("reason", reason)
        .withColumn("seq", F.col("_p.seq"))
        .withColumn("rows", F.when(F.col("reason").isNull(), rows))
        .drop("_p")
    )


def payload_rows(accepted: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per payload row: ``keep..., batch_no, row_no`` and the cells under their names."""
    exploded = accepted.select(*keep, F.col("seq").alias("batch_no"), F.posexplode("rows").alias("_pos", "_cells"))
    return exploded.select(
        *keep,
        "batch_no",
        (F.col("_pos") + 1).cast("bigint").alias("row_no"),
        *[F.col("_cells")[i].alias(name) for i, name in enumerate(columns)],
    )
