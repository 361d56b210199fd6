"""Target metadata out of CREATE TABLE texts, so that what was declared can be audited like what exists.

One text is one row; names are in back quotes. Items are cut at the commas outside quotes and brackets (three
levels deep), so neither line breaks nor commas in defaults matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = "`(?:[^`]|``)*+`"
_TEXT = r"'(?:[^'\\]|''|\\.)*+'"
_INNER = rf"(?:[^()'`]|{_NAME}|{_TEXT})"
_NESTED = rf"(?:{_INNER}|\((?:{_INNER}|\({_INNER}*+\))*+\))"
_ITEM = rf"(?s)(?:[^,()'`]|{_NAME}|{_TEXT}|\({_NESTED}*+\))++"
_TABLE = rf"(?is)^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})\s*\((.*)\)([^)]*)$"
_COLUMN = rf"(?s)^\s*({_NAME})\s+(\w+)\s*(?:\(((?:[^()']|{_TEXT})*+)\))?(.*)$"
_KEY = rf"(?is)^\s*(?:CONSTRAINT\s+(?:{_NAME}\s+)?)?(PRIMARY\s+KEY|UNIQUE(?:\s+(?:KEY|INDEX))?)\s*({_NAME})?\s*\((.*)\)\s*$"


def unquoted(name: Column) -> Column:
    return F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit("``"), F.lit("`"))


_OWN_PRIMARY = r"\bPRIMARY\s+KEY\b"
_OWN_KEY = rf"{_OWN_PRIMARY}|\bUNIQUE\b"


def _words() -> Column:
    """What follows the type of a column, in upper case and without texts."""
    return F.upper(F.regexp_replace(_part("item", _COLUMN, 4), _TEXT, "''"))


def _part(text: str | Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def read_items(texts: DataFrame) -> DataFrame:
    """``task, target_table, charset, ordinal, item`` of ``task, ddl``; a text that is no CREATE TABLE gives nothing.

    Lines that begin with `--` are remarks.
    """
    plain = texts.select("task", F.regexp_replace("ddl", r"(?m)^\s*--.*$", "").alias("ddl"))
    tables = plain.filter(F.col("ddl").rlike(_TABLE)).select(
        "task",
        unquoted(_part("ddl", _TABLE, 1)).alias("target_table"),
        F.lower(_part(_part("ddl", _TABLE, 3), r"(?i)CHAR(?:ACTER\s+)?SET\s*=?\s*(\w+)", 1)).alias("charset"),
        F.regexp_extract_all(_part("ddl", _TABLE, 2), F.lit(_ITEM), F.lit(0)).alias("items"),
    )
    items = tables.select("task", "target_table", "charset", F.posexplode("items").alias("at", "item"))
    return items.select("task", "target_table", "charset", (F.col("at") + 1).cast("bigint").alias("ordinal"), F.trim(F.regexp_replace("item", r"^\s+|\s+$", "")).alias("item"))


def read_keys(texts: DataFrame) -> DataFrame:
    """``task, key_name, key_columns`` of the PRIMARY and UNIQUE keys, also those a column declares.

    A key without name is named after its first column.
    """
    items = read_items(texts)
    keys = items.filter(F.col("item").rlike(_KEY))
    column, words = unquoted(_part("item", _COLUMN, 1)), _words()
    inline = items.filter(F.col("item").rlike(_COLUMN) & words.rlike(_OWN_KEY)).select(
        "task", F.when(words.rlike(_OWN_PRIMARY), "PRIMARY").otherwise(column).alias("key_name"), F.array(column).alias("key_columns")
    )
    named = F.regexp_extract_all(_part("item", _KEY, 3), F.lit(f"({_NAME})"), F.lit(1))
    columns = F.transform(named, unquoted)
    own = _part("item", _KEY, 2)
    name = F.when(F.upper("item").rlike(r"PRIMARY\s+KEY\s*[(`]"), "PRIMARY").when(own != "", unquoted(own)).otherwise(F.try_element_at(columns, F.lit(1)))
    return keys.select("task", name.alias("key_name"), columns.alias("key_columns")).unionByName(inline)


def read_columns(texts: DataFrame) -> DataFrame:
    """Target columns as `mapping_audit` takes them.

    A column of the PRIMARY KEY is not nullable, a decimal without digits is DECIMAL(10,0), a datetime without them
    has no fraction, and a number that is none, such as a placeholder, is NULL.
    """
    items = read_items(texts).filter(F.col("item").rlike(_COLUMN))
    kind, args, rest = F.lower(_part("item", _COLUMN, 2)), _part("item", _COLUMN, 3), _part("item", _COLUMN, 4)
    words = _words()
    first, second = (F.try_element_at(F.split(args, r"\s*,\s*"), F.lit(k)).try_cast("bigint") for k in (1, 2))
    bare = args == ""
    decimal, timed = kind.isin("decimal", "numeric"), kind.isin("datetime", "timestamp", "time")
    text = kind.isin("varchar", "char", "text", "tinytext", "mediumtext", "longtext")
    given = _part(words, r"(?:CHARACTER\s+SET|CHARSET)\s+(\w+)", 1)
    default = _part(rest, rf"(?is)\bDEFAULT\s+({_TEXT}|[^\s,]+)", 1)
    zero = F.lit(0).cast("bigint")
    rows = items.select(
        "task",
        "ordinal",
        unquoted(_part("item", _COLUMN, 1)).alias("column_name"),
        F.concat(kind, F.when(bare, "").otherwise(F.concat(F.lit("("), F.regexp_replace(args, r"\s", ""), F.lit(")")))).alias("column_type"),
        F.when(kind == "numeric", "decimal").otherwise(kind).alias("data_type"),
        F.when(decimal, F.when(bare, F.lit(10).cast("bigint")).otherwise(first)).alias("precision"),
        F.when(decimal, F.when(bare | ~args.contains(","), zero).otherwise(second)).alias("scale"),
        F.when(text, first).alias("length"),
        F.when(timed, F.when(bare, zero).otherwise(first)).alias("datetime_precision"),
        (~words.rlike(r"\bNOT\s+NULL\b")).alias("open"),
        F.when(text, F.when(given != "", F.lower(given)).otherwise(F.nullif("charset", F.lit("")))).alias("character_set"),
        F.when((default != "") & (F.upper(default) != "NULL"), F.when(default.startswith("'"), F.replace(F.substring(default, F.lit(2), F.length(default) - 2), F.lit("''"), F.lit("'"))).otherwise(default)).alias("default_value"),
        F.when(words.contains("AUTO_INCREMENT"), "AUTO_INCREMENT").otherwise("").alias("extra"),
    )
    primary = read_keys(texts).filter("key_name = 'PRIMARY'").select("task", F.explode("key_columns").alias("key_column"))
    primary = primary.select("task", F.upper("key_column").alias("name_key"), F.lit(True).alias("in_key")).distinct()
    joined = rows.withColumn("name_key", F.upper("column_name")).join(primary, ["task", "name_key"], "left")
    shown = [c if c != "open" else (F.col("open") & F.col("in_key").isNull()).alias("nullable") for c in rows.columns]
    return joined.select(*shown)


def unread(texts: DataFrame) -> DataFrame:
    """``task, ordinal, item``: what is neither a column nor a key, and, as item 0, a text that is no CREATE TABLE."""
    whole = F.regexp_replace("ddl", r"(?m)^\s*--.*$", "").rlike(_TABLE)
    none = texts.filter(~F.coalesce(whole, F.lit(False))).select("task", F.lit(0).cast("bigint").alias("ordinal"), F.col("ddl").alias("item"))
    items = read_items(texts).filter(~F.col("item").rlike(_COLUMN) & ~F.col("item").rlike(_KEY))
    return items.select("task", "ordinal", "item").unionByName(none)
