"""Value checks that take one scan whatever the number of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions import canon


@dataclass(frozen=True)
class RangeCheck:
    """Values of `column` must fit DECIMAL(precision, scale) without loss."""

    column: str
    precision: int
    scale: int


def loses_value(df: DataFrame, check: RangeCheck) -> Column:
    """True for a value that DECIMAL(precision, scale) would round or overflow."""
    kind = df.schema[check.column].dataType
    value = F.col(check.column)
    if isinstance(kind, T.StringType):
        return ~canon.is_canonical_number(value) | ~canon.fits_decimal(value, check.precision, check.scale)
    if isinstance(kind, T.IntegralType):
        value, kind = value.cast("decimal(20,0)"), T.DecimalType(20, 0)
    if not isinstance(kind, T.DecimalType):
        raise TypeError(f"{check.column}: range checks need a decimal, integer or canonical text")
    whole = check.precision - check.scale
    # Compared in the value's own type: Spark's common type of both sides may drop a digit.
    kept = F.round(value, check.scale).try_cast(kind)
    rounded = ~value.eqNullSafe(kept) if check.scale < kind.scale else F.lit(False)
    # A type with no more integer digits than the target cannot overflow it; otherwise the
    # bound is an exact decimal literal that fits the value's own type.
    if whole >= kind.precision - kind.scale:
        return rounded
    return rounded | (F.abs(value) >= F.lit(Decimal(10) ** whole))


def range_audit(df: DataFrame, checks: Sequence[RangeCheck]) -> DataFrame:
    """Rows ``column_name, scanned_rows, invalid_rows`` from a single aggregation.

    With no checks there is nothing to scan, and the result is empty without a job.
    """
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "column_name string, scanned_rows bigint, invalid_rows bigint"
        )
    counts = [
        F.count_if(F.col(c.column).isNotNull() & loses_value(df, c)).alias(f"invalid_{i}")
        for i, c in enumerate(checks)
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c.column).alias("column_name"),
                F.col("scanned_rows"),
                F.col(f"invalid_{i}").alias("invalid_rows"),
            )
            for i, c in enumerate(checks)
        ]
    )
    return (
        df.agg(F.count("*").alias("scanned_rows"), *counts).select(F.explode(rows).alias("r")).select("r.*")
    )


@dataclass(frozen=True)
class CellRule:
    """Why a cell of `column` is refused: `reason` is NULL for a good one; `shown` is its value."""

    column: str
    reason: Column
    shown: Column


def canonical_rules(df: DataFrame, columns: Sequence[str]) -> list[CellRule]:
    """Source-side rules of number texts and time columns."""
    rules = []
    for name in columns:
        kind, value = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.StringType):
            reason = F.when(~canon.is_canonical_number(value), "NUMBER_NOT_CANONICAL")
            rules.append(CellRule(name, reason, value))
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            reason = F.when(~F.year(value).between(1, 9999), "YEAR_OUT_OF_RANGE")
            rules.append(CellRule(name, reason, value.cast("string")))
    return rules


def decimal_target_rule(name: str, precision: int, scale: int) -> CellRule:
    """A canonical text on its way to DECIMAL(p,s): not a number, overflow, silent rounding."""
    value = F.col(name)
    reason = (
        F.when(~canon.is_canonical_number(value), "NOT_A_NUMBER")
        .when(canon.integer_digits(value) > precision - scale, "OUT_OF_RANGE")
        .when(canon.fraction_digits(value) > scale, "WOULD_ROUND")
    )
    return CellRule(name, reason, value)


def datetime_target_rule(name: str, fraction: bool = False) -> CellRule:
    """Canonical time text on its way to DATETIME(0) or DATETIME(6)."""
    value = F.col(name)
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}" + (r"\.[0-9]{6}\z" if fraction else r"\z")
    parsed = value.try_cast("timestamp_ntz")
    bad = ~value.rlike(form) | parsed.isNull() | (F.year(parsed) < 1)
    return CellRule(name, F.when(bad, "BAD_DATETIME"), value)


def varchar_target_rule(name: str, length: int) -> CellRule:
    """Text on its way to VARCHAR(n) in utf8mb4."""
    value = F.col(name)
    reason = F.when(~F.is_valid_utf8(value), "BAD_CHARSET").when(F.char_length(value) > length, "TOO_LONG")
    return CellRule(name, reason, value)


# The target database's code for each refusal.
TARGET_CODES = {
    "OUT_OF_RANGE": 1264,
    "WOULD_ROUND": 1265,
    "BAD_DATETIME": 1292,
    "NOT_A_NUMBER": 1366,
    "BAD_CHARSET": 1366,
    "TOO_LONG": 1406,
}


def target_code(reason: Column) -> Column:
    pairs = [F.lit(part) for pair in TARGET_CODES.items() for part in pair]
    return F.element_at(F.create_map(*pairs), reason)


def reject_rows(df: DataFrame, key: Sequence[str], rules: Sequence[CellRule]) -> DataFrame:
    """One row ``key..., column_name, value, reason`` per refused cell; NULL is never refused.

    A narrow pass: rows without a refused cell are dropped before they leave their partition.
    """
    judged = [
        F.struct(
            F.lit(r.column).alias("column_name"),
            r.shown.alias("value"),
            F.when(F.col(r.column).isNotNull(), r.reason).alias("reason"),
        )
        for r in rules
    ]
    refused = F.filter(F.array(*judged), lambda c: c["reason"].isNotNull())
    return df.select(*key, F.explode(refused).alias("c")).select(*key, "c.*")
