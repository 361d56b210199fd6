"""Column profiles and the type census.

Each profile is one aggregation over the table for all columns of a kind, turned into long
rows ``column_name, data_type, kind, value, value_len``; a missing value shows as `<NULL>`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.functions import canon, shapes


def _largest(order: Column, text: Column) -> Column:
    """The text with the largest `order`; among equals the largest text."""
    return F.max(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("v"))))["v"]


def _numeric_parts(value: Column, text: Column) -> list[tuple[str, Column]]:
    fraction = canon.fraction_digits(text)
    return [
        ("max_len_val", _largest(F.char_length(text), text)),
        ("min_val", canon.number_text(F.min(value))),
        ("max_val", canon.number_text(F.max(value))),
        ("max_scale_val", _largest(fraction, F.when(fraction > 0, text))),
        ("zero_cnt", F.count_if(value == 0).cast("string")),
        ("null_cnt", F.count_if(value.isNull()).cast("string")),
    ]


def _time_parts(value: Column, text: Column) -> list[tuple[str, Column]]:
    midnight = value.cast("date").cast("timestamp_ntz")
    return [
        ("min_val", canon.timestamp_text(F.min(value))),
        ("max_val", canon.timestamp_text(F.max(value))),
        ("with_time_cnt", F.count_if(value != midnight).cast("string")),
        ("null_cnt", F.count_if(value.isNull()).cast("string")),
    ]


def _text_parts(value: Column, text: Column) -> list[tuple[str, Column]]:
    return [
        ("max_len_val", _largest(F.char_length(value), value)),
        ("multibyte_val", F.max(F.when(F.octet_length(value) > F.char_length(value), value))),
        ("null_cnt", F.count_if(value.isNull()).cast("string")),
    ]


def _profile(df: DataFrame, columns: Sequence[str], parts_of, text_of=None) -> DataFrame:
    # Texts are made once per value, below the aggregation that uses them several times.
    made = [] if text_of is None else [text_of(F.col(c)).alias(f"_text_{i}") for i, c in enumerate(columns)]
    values = df.select(*[F.col(c).alias(f"_value_{i}") for i, c in enumerate(columns)], *made)
    aggregates, rows = [], []
    for i, name in enumerate(columns):
        text = F.col(f"_value_{i}" if text_of is None else f"_text_{i}")
        for kind, value in parts_of(F.col(f"_value_{i}"), text):
            alias = f"{kind}_{i}"
            aggregates.append(value.alias(alias))
            rows.append(
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(df.schema[name].dataType.simpleString()).alias("data_type"),
                    F.lit(kind).alias("kind"),
                    F.coalesce(alias, F.lit("<NULL>")).alias("value"),
                    F.coalesce(F.char_length(alias), F.lit(0)).alias("value_len"),
                )
            )
    return values.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Longest value, extremes, value of highest scale, zeros and NULLs of decimal columns."""
    return _profile(df, columns, _numeric_parts, canon.number_text)


def profile_time(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Extremes, values off midnight and NULLs of timestamp_ntz columns."""
    return _profile(df, columns, _time_parts)


def profile_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Longest value, one multi-byte value and NULLs of text columns."""
    return _profile(df, columns, _text_parts)


def type_census(source_columns: DataFrame) -> DataFrame:
    """Per task: each distinct (type, precision, scale), its column count and its columns.

    The name list is bounded by the columns one table can have.
    """
    return source_columns.groupBy("task", "type_name", "precision", "scale").agg(
        F.count("*").alias("col_count"),
        F.min("column_name").alias("sample_col"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))),
                lambda c: c["column_name"],
            ),
            " ",
        ).alias("columns"),
    )


def unsupported_types(source_columns: DataFrame) -> DataFrame:
    """Columns that need attention before a copy: ``task, ordinal, column_name, finding``."""
    finding = """CASE WHEN shape.rejection IN ('TYPE_NOT_LISTED', 'FSP_TOO_PRECISE') THEN shape.rejection
                      WHEN shape.support = 'needs_precision' THEN 'BARE_NUMBER' END AS finding"""
    return (
        shapes.with_shape(source_columns)
        .selectExpr("task", "ordinal", "column_name", "type_name", finding)
        .filter(F.col("finding").isNotNull())
    )
