"""Target shape of a source column, and how both sides are shown in an issue.

A source column is one metadata row with ``type_name, precision, scale, length, fsp``; the
expressions here read those columns by name. The derived shape is one struct column, so every
rule that needs it reads the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source type names accepted as text, and the limits of the target DECIMAL.
TEXT_TYPES = ("VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR")
MAX_PRECISION = 65
MAX_SCALE = 30
MAX_FSP = 6
MAX_TARGET_NAME = 37

# Why no shape can be derived: code, message, suggestion.
REJECTIONS = (
    ("NUMBER_HALF_DECLARED", "NUMBER declares only one of precision and scale", "declare (p,s) for this column in the task"),
    ("LENGTH_MISSING", "a character column needs a known length", "add a CAST that states the character length"),
    ("FSP_MISSING", "a TIMESTAMP needs known fraction digits", "add a CAST to TIMESTAMP(0..6)"),
    ("FSP_TOO_PRECISE", "TIMESTAMP with more than 6 fraction digits is not supported", "add a CAST to TIMESTAMP(6)"),
    ("DECIMAL_UNREPRESENTABLE", "the derived shape exceeds DECIMAL(65,30)", "no target shape exists; narrow the column with a CAST"),
    ("TYPE_NOT_LISTED", "the source type is not one of the nine supported shapes", "add a CAST to a supported type"),
)



def is_decimal_shape(precision: Column, scale: Column) -> Column:
    """A decimal the target can hold: 1..65 digits, 0..30 of them in the fraction."""
    return precision.between(1, MAX_PRECISION) & scale.between(0, MAX_SCALE) & (scale <= precision)


_IS_TEXT = f"upper(type_name) IN {TEXT_TYPES}"
_BARE = "(upper(type_name) = 'NUMBER' AND precision IS NULL AND scale IS NULL)"
# Metadata may carry any 64-bit value, so a negative scale widens by a sum that saturates.
_WIDENED = (
    "coalesce(try_add(CAST(precision AS BIGINT), coalesce(try_subtract(0L, CAST(scale AS BIGINT)), "
    "9223372036854775807L)), 9223372036854775807L)"
)
_NUMBER_SHAPE = f"""named_struct(
    'p', CASE WHEN scale < 0 THEN {_WIDENED} WHEN scale > precision THEN CAST(scale AS BIGINT)
              ELSE CAST(precision AS BIGINT) END,
    's', CASE WHEN scale < 0 THEN 0L ELSE CAST(scale AS BIGINT) END)"""
_REJECTION = f"""CASE
    WHEN {_BARE} THEN NULL
    WHEN upper(type_name) = 'NUMBER' AND (precision IS NULL OR scale IS NULL) THEN 'NUMBER_HALF_DECLARED'
    WHEN upper(type_name) = 'NUMBER' AND NOT (_number.p BETWEEN 1 AND {MAX_PRECISION}
         AND _number.s BETWEEN 0 AND {MAX_SCALE} AND _number.s <= _number.p) THEN 'DECIMAL_UNREPRESENTABLE'
    WHEN upper(type_name) = 'NUMBER' THEN NULL
    WHEN {_IS_TEXT} AND length IS NULL THEN 'LENGTH_MISSING'
    WHEN {_IS_TEXT} OR upper(type_name) = 'DATE' THEN NULL
    WHEN upper(type_name) = 'TIMESTAMP' AND fsp IS NULL THEN 'FSP_MISSING'
    WHEN upper(type_name) = 'TIMESTAMP' AND fsp > {MAX_FSP} THEN 'FSP_TOO_PRECISE'
    WHEN upper(type_name) = 'TIMESTAMP' THEN NULL
    ELSE 'TYPE_NOT_LISTED' END"""
_SHAPE = f"""named_struct(
    'support', CASE WHEN _rejection IS NOT NULL THEN 'unsupported' WHEN {_BARE} THEN 'needs_precision' ELSE 'ok' END,
    'family', CASE WHEN _rejection IS NOT NULL OR {_BARE} THEN NULL WHEN upper(type_name) = 'NUMBER' THEN 'decimal'
                   WHEN {_IS_TEXT} THEN 'varchar' ELSE 'datetime' END,
    'precision', _number.p,
    'scale', _number.s,
    'length', CASE WHEN _rejection IS NULL AND {_IS_TEXT} THEN CAST(length AS BIGINT) END,
    'fsp', CASE WHEN _rejection IS NOT NULL THEN NULL WHEN upper(type_name) = 'DATE' THEN 0L
                WHEN upper(type_name) = 'TIMESTAMP' THEN {MAX_FSP}L END,
    'rejection', _rejection)"""
_SOURCE_TEXT = f"""CASE
    WHEN upper(type_name) = 'NUMBER' THEN coalesce('NUMBER(' || precision || ',' || scale || ')', 'NUMBER(?,?)')
    WHEN {_IS_TEXT} THEN upper(type_name) || '(' || coalesce(CAST(length AS STRING), '?') || ')'
    WHEN upper(type_name) = 'DATE' THEN 'DATE'
    WHEN upper(type_name) = 'TIMESTAMP' THEN 'TIMESTAMP(' || coalesce(CAST(fsp AS STRING), '?') || ')'
    ELSE type_name END"""


def with_shape(columns: DataFrame) -> DataFrame:
    """Add ``shape`` and ``source`` (display text, `?` for a part the metadata does not give).

    ``shape`` is STRUCT<support, family, precision, scale, length, fsp, rejection>; support is
    ``ok``, ``needs_precision`` (a bare NUMBER, whose shape the task must declare) or
    ``unsupported``, and rejection holds the reason code of the last.
    """
    return (
        columns.withColumn("_number", F.expr(_NUMBER_SHAPE))
        .withColumn("_rejection", F.expr(_REJECTION))
        .withColumns({"shape": F.expr(_SHAPE), "source": F.expr(_SOURCE_TEXT)})
        .drop("_number", "_rejection")
    )


# Text of the struct column `shape`; NULL when no shape was derived.
SHAPE_TEXT = """CASE shape.family
    WHEN 'decimal' THEN 'DECIMAL(' || shape.precision || ',' || shape.scale || ')'
    WHEN 'varchar' THEN 'VARCHAR(' || shape.length || ')'
    WHEN 'datetime' THEN 'DATETIME(' || shape.fsp || ')' END"""


def shape_text() -> Column:
    """`DECIMAL(p,s)`, `VARCHAR(n)` or `DATETIME(f)` of the column ``shape``."""
    return F.expr(SHAPE_TEXT)


def lookup(code: str, position: int) -> str:
    """SQL text that looks up the message (1) or suggestion (2) of a rejection code."""
    arms = " ".join(f"WHEN '{row[0]}' THEN '{row[position]}'" for row in REJECTIONS)
    return f"CASE {code} {arms} END"


def decimal_text(precision: Column, scale: Column) -> Column:
    return F.concat(
        F.lit("DECIMAL("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")
    )


def may_filter_by_date(type_name: Column, fsp: Column) -> Column:
    """Whether a column can carry a date condition: DATE or TIMESTAMP(0..6)."""
    kind = F.upper(type_name)
    return F.coalesce((kind == "DATE") | ((kind == "TIMESTAMP") & (fsp <= MAX_FSP)), F.lit(False))
