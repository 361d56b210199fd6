"""Canonical text form of a value, as Column expressions.

A value that is not canonical is reported, never repaired. NULL bypasses every rule and
stays distinct from the empty string; text is never trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the grammar of a canonical number (zero, |x| >= 1, |x| < 1).
NUMBER_GRAMMAR = r"(0|-?[1-9][0-9]*(\.[0-9]*[1-9])?|-?0\.[0-9]*[1-9])"

_MIN_YEAR, _MAX_YEAR = 1, 9999


def is_canonical_number(text: Column) -> Column:
    """True when the text is a canonical number; NULL for NULL.

    The end anchor is ``\\z`` because ``$`` in Java regular expressions also accepts a
    trailing line feed.
    """
    return text.rlike("^" + NUMBER_GRAMMAR + r"\z")


def canon_number(text: Column) -> Column:
    """The text itself when canonical, NULL otherwise (pair with `is_canonical_number`)."""
    return F.when(is_canonical_number(text), text)


def number_text(value: Column) -> Column:
    """Canonical text of a decimal: no trailing fraction zeros, `0.` kept, no exponent."""
    text = value.cast("string")
    trimmed = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(F.contains(text, F.lit(".")), trimmed).otherwise(text)


def _plain(value: Column) -> Column:
    # The text of a timestamp_ntz does not pass through the session time zone, as date_format does.
    return value.cast("timestamp_ntz").cast("string")


def date_text(value: Column) -> Column:
    """Canonical text `YYYY-MM-DD HH:MM:SS` of a timestamp_ntz that carries a DATE."""
    return F.substring(_plain(value), 1, 19)


def timestamp_text(value: Column) -> Column:
    """Canonical text of a timestamp_ntz: always six fraction digits."""
    text = _plain(value)
    return F.concat(F.substring(text, 1, 19), F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0"))


def _moment(year, month, day, hour, minute, second) -> Column:
    # make_timestamp rolls second 60 over into the next minute, the rule here refuses it.
    in_range = year.between(_MIN_YEAR, _MAX_YEAR) & second.between(0, 59)
    return F.when(
        in_range,
        F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)")),
    )


def canon_date(year, month, day, hour, minute, second) -> Column:
    """DATE components to canonical text; NULL when they are no moment of years 1..9999."""
    return date_text(_moment(year, month, day, hour, minute, second))


def canon_timestamp(year, month, day, hour, minute, second, nanosecond) -> Column:
    """TIMESTAMP components to canonical text; digits below a microsecond are refused."""
    whole_micros = nanosecond.between(0, 999_999_999) & (nanosecond % 1000 == 0)
    micros = F.lpad((nanosecond / 1000).cast("bigint").cast("string"), 6, "0")
    return F.when(
        whole_micros,
        F.concat(canon_date(year, month, day, hour, minute, second), F.lit("."), micros),
    )


def integer_digits(text: Column) -> Column:
    """Significant integer digits of a canonical number; a lone `0` counts as none."""
    whole = F.ltrim(F.substring_index(text, ".", 1), F.lit("-"))
    return F.when(whole == "0", 0).otherwise(F.char_length(whole))


def fraction_digits(text: Column) -> Column:
    """Fraction digits of a canonical number."""
    point = F.instr(text, ".")
    return F.when(point == 0, 0).otherwise(F.char_length(text) - point)


def fits_decimal(text: Column, precision: Column | int, scale: Column | int) -> Column:
    """Whether a canonical number fits DECIMAL(precision, scale) without rounding.

    Works on digit counts, so it also holds beyond the 38 digits of Spark's decimal.
    """
    precision = precision if isinstance(precision, Column) else F.lit(precision)
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return (fraction_digits(text) <= scale) & (integer_digits(text) <= precision - scale)
