"""Mapping audit: every problem between source and target columns, for any number of tasks.

Inputs, one row each:

* ``tasks``: task, target_table, key_columns ARRAY<STRING>
* ``source_columns``: task, ordinal, column_name, type_name, precision, scale, length, fsp
* ``target_columns``: task, ordinal, column_name, column_type, data_type, precision, scale,
  length, datetime_precision, nullable, character_set, default_value, extra
* ``target_keys``: task, key_name, key_columns ARRAY<STRING>

Columns are matched by upper-cased name, never by position. All joins run on (task, upper-cased
name), which spreads over the cluster even when one task owns a large share of the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.functions import shapes

ISSUE_COLUMNS = ("task", "column_name", "source", "target", "rule", "detail", "suggestion")
_ALIGN = ["task", "name_key"]


def _key_columns(tasks: DataFrame) -> DataFrame:
    return (
        tasks.select("task", F.explode("key_columns").alias("key_column"))
        .withColumn("name_key", F.upper("key_column"))
        .groupBy(*_ALIGN)
        .agg(F.min("key_column").alias("key_column"))
    )


def align_columns(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Source columns with their target column (struct ``t``, NULL when the target lacks it)."""
    target = target_columns.select(
        "task",
        F.upper("column_name").alias("name_key"),
        F.struct(*[c for c in target_columns.columns if c != "task"]).alias("t"),
    )
    return source_columns.withColumn("name_key", F.upper("column_name")).join(
        target, _ALIGN, "left"
    )


def unmapped_targets(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Target columns no source column maps to."""
    mapped = source_columns.select("task", F.upper("column_name").alias("name_key"))
    return (
        target_columns.withColumn("name_key", F.upper("column_name"))
        .join(mapped, _ALIGN, "left_anti")
        .drop("name_key")
    )


_FIX = f"'change to ' || {shapes.SHAPE_TEXT}"
_DECLARE_AND_ADD = "'declare (p,s) for this column and add the DECIMAL column'"
_TARGET_FIX = f"""CASE
    WHEN shape.support = 'ok' THEN 'add the target column ' || {shapes.SHAPE_TEXT} || ' NULL'
    WHEN shape.support = 'needs_precision' OR shape.rejection = 'NUMBER_HALF_DECLARED' THEN {_DECLARE_AND_ADD}
    WHEN shape.rejection IN ('DECIMAL_UNREPRESENTABLE', 'LENGTH_MISSING') THEN {shapes.lookup('shape.rejection', 2)}
    ELSE 'drop the column from the task, or add a compatible target column' END"""
# A declared NUMBER needs a target that keeps its scale and its integer digits.
_DECIMAL = "shape.family = 'decimal' AND lower(t.data_type) = 'decimal'"
_SCALE_SHORT = "t.scale < shape.scale"
_WHOLE_SHORT = "(t.precision < t.scale OR t.precision - t.scale < shape.precision - shape.scale)"
_SCALE_TEXT = "'scale ' || t.scale || ' < ' || shape.scale"
_WHOLE_TEXT = "'integer digits ' || greatest(t.precision - t.scale, 0) || ' < ' || (shape.precision - shape.scale)"
_BARE = "shape.support = 'needs_precision' AND t IS NOT NULL"
_VALID = "coalesce(t.precision BETWEEN 1 AND 65 AND t.scale BETWEEN 0 AND 30 AND t.scale <= t.precision, false)"
_TEXT = "shape.family = 'varchar' AND t IS NOT NULL"
_TIME = "shape.family = 'datetime' AND t IS NOT NULL"
_TIME_NAME = "if(shape.fsp = 0, 'DATE', 'TIMESTAMP')"

# Rules over one aligned column: condition, rule, detail and suggestion, all SQL texts.
COLUMN_RULES = (
    ("repeated", "'SOURCE_REPEATED'", "'the source column name is not unique'", "'give every source column its own name'"),
    ("t IS NULL", "'TARGET_MISSING'", "'the target has no column of this name'", _TARGET_FIX),
    (
        "shape.rejection IS NOT NULL",
        "shape.rejection",
        shapes.lookup("shape.rejection", 1),
        shapes.lookup("shape.rejection", 2),
    ),
    (
        "shape.family = 'decimal' AND lower(t.data_type) <> 'decimal'",
        "'NUMBER_TARGET_NOT_DECIMAL'",
        "'a NUMBER needs a DECIMAL target'",
        _FIX,
    ),
    (
        f"{_DECIMAL} AND (t.precision IS NULL OR t.scale IS NULL)",
        "'DECIMAL_UNDECLARED'",
        "'the target DECIMAL gives no precision and scale'",
        _FIX,
    ),
    (f"{_DECIMAL} AND {_SCALE_SHORT} AND {_WHOLE_SHORT}", "'SCALE_AND_INTEGER_SHORT'", f"{_SCALE_TEXT} || '; ' || {_WHOLE_TEXT}", _FIX),
    (f"{_DECIMAL} AND {_SCALE_SHORT} AND NOT {_WHOLE_SHORT}", "'SCALE_SHORT'", f"{_SCALE_TEXT} || ', values would be rounded silently'", _FIX),
    (f"{_DECIMAL} AND NOT {_SCALE_SHORT} AND {_WHOLE_SHORT}", "'INTEGER_SHORT'", _WHOLE_TEXT, _FIX),
    # A bare NUMBER takes its shape from the target DECIMAL.
    (
        "shape.support = 'needs_precision' AND t IS NULL",
        "'NUMBER_SHAPE_UNKNOWN'",
        "'a bare NUMBER needs a target DECIMAL shape'",
        _DECLARE_AND_ADD,
    ),
    (
        f"{_BARE} AND lower(t.data_type) <> 'decimal'",
        "'NUMBER_TARGET_NOT_DECIMAL'",
        "'a NUMBER needs a DECIMAL target'",
        "'declare (p,s) for this column and change the target to that DECIMAL'",
    ),
    (
        f"{_BARE} AND lower(t.data_type) = 'decimal' AND NOT {_VALID}",
        "'DECIMAL_SHAPE_INVALID'",
        "'the target DECIMAL of a bare NUMBER has no valid precision and scale'",
        "'give the target DECIMAL a valid (p,s)'",
    ),
    (f"{_TEXT} AND lower(t.data_type) <> 'varchar'", "'TEXT_TARGET_NOT_VARCHAR'", "'a character column needs a VARCHAR target'", _FIX),
    (
        f"{_TEXT} AND lower(t.data_type) = 'varchar' AND (t.length IS NULL OR t.length < shape.length)",
        "'TEXT_TOO_SHORT'",
        "'the target VARCHAR is shorter than the source length (bytes or characters as the source declares)'",
        _FIX,
    ),
    (f"{_TEXT} AND NOT t.character_set <=> 'utf8mb4'", "'TEXT_CHARSET'", "'the target VARCHAR must use utf8mb4'", "'change to utf8mb4'"),
    (f"{_TIME} AND lower(t.data_type) <> 'datetime'", "'TIME_TARGET_NOT_DATETIME'", f"{_TIME_NAME} || ' needs a DATETIME target'", _FIX),
    (
        f"{_TIME} AND lower(t.data_type) = 'datetime' AND NOT t.datetime_precision <=> shape.fsp",
        "'TIME_FRACTION'",
        f"{_TIME_NAME} || ' needs exactly ' || shape.fsp || ' fraction digits'",
        _FIX,
    ),
    ("NOT t.nullable AND is_key IS NULL", "'TARGET_NOT_NULLABLE'", "'the target column must accept NULL'", "'change to NULL'"),
)


def _column_issues(source: DataFrame, target: DataFrame, keys: DataFrame) -> DataFrame:
    first = Window.partitionBy(*_ALIGN).orderBy("ordinal")
    rows = (
        align_columns(shapes.with_shape(source), target)
        .join(keys.withColumn("is_key", F.lit(True)), _ALIGN, "left")
        .withColumn("repeated", F.row_number().over(first) > 1)
    )
    found = ", ".join(
        f"if({when}, named_struct('rule', {rule}, 'detail', {detail}, 'suggestion', {fix}), NULL)"
        for when, rule, detail, fix in COLUMN_RULES
    )
    return rows.selectExpr(
        "task",
        "column_name",
        "source",
        "if(t IS NULL, '<missing>', upper(t.column_type)) AS target",
        f"inline(array_compact(array({found})))",
    )


def _unmapped_issues(source: DataFrame, target: DataFrame) -> DataFrame:
    fills_itself = F.lower(F.coalesce("extra", F.lit(""))).contains("auto_increment")
    return (
        unmapped_targets(source, target)
        .filter(~F.col("nullable") & F.col("default_value").isNull() & ~fills_itself)
        .select(
            "task",
            "column_name",
            F.lit("<unmapped>").alias("source"),
            F.upper("column_type").alias("target"),
            F.lit("REQUIRED_UNMAPPED").alias("rule"),
            F.lit("the target column is required but nothing maps to it").alias("detail"),
            F.lit("map the column or give it a default").alias("suggestion"),
        )
    )


def _key_column_issues(keys: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    selected = source.select(
        "task", F.upper("column_name").alias("name_key"), F.lit(True).alias("selected")
    ).distinct()
    described = target.select(
        "task", F.upper("column_name").alias("name_key"), "nullable", F.upper("column_type").alias("shown")
    )
    rows = keys.join(selected, _ALIGN, "left").join(described, _ALIGN, "left")
    unselected = F.col("selected").isNull()
    return (
        rows.filter(unselected | F.col("nullable"))
        .select(
            "task",
            F.col("key_column").alias("column_name"),
            F.when(unselected, "<missing>").otherwise("-").alias("source"),
            F.coalesce("shown", F.lit("<missing>")).alias("target"),
            F.when(unselected, "KEY_NOT_SELECTED").otherwise("KEY_NULLABLE").alias("rule"),
            F.when(unselected, "the key column is not among the selected columns")
            .otherwise("the key column must be NOT NULL")
            .alias("detail"),
            F.when(unselected, "select the column or choose another key")
            .otherwise("change the target column to NOT NULL")
            .alias("suggestion"),
        )
    )


def _folded(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(names, F.upper)))


def _unique_key_issues(tasks: DataFrame, target_keys: DataFrame) -> DataFrame:
    """The chosen key must equal the column set of one PRIMARY or UNIQUE key of the target.

    The keys of one table are few by nature (the target database allows 64), so showing them
    in one text per task is bounded.
    """
    chosen = tasks.filter(F.size("key_columns") > 0).select(
        "task", "key_columns", _folded(F.col("key_columns")).alias("wanted")
    )
    offered = target_keys.select(
        "task",
        "key_name",
        F.col("key_columns").alias("offered_columns"),
        _folded(F.col("key_columns")).alias("offered"),
    )
    shown = F.concat("key_name", F.lit("("), F.array_join("offered_columns", ","), F.lit(")"))
    return (
        chosen.join(offered, "task", "left")
        .groupBy("task", "key_columns")
        .agg(
            F.bool_or(F.coalesce(F.col("wanted") == F.col("offered"), F.lit(False))).alias("covered"),
            F.array_sort(F.collect_list(F.when(F.col("key_name").isNotNull(), shown))).alias("keys"),
        )
        .filter(~F.col("covered"))
        .select(
            "task",
            F.lit("<primary_key>").alias("column_name"),
            F.array_join("key_columns", ",").alias("source"),
            F.when(F.size("keys") == 0, "<no unique key>").otherwise(F.array_join("keys", "; ")).alias("target"),
            F.lit("KEY_NOT_UNIQUE").alias("rule"),
            F.lit("no PRIMARY or UNIQUE key of the target has exactly these columns").alias("detail"),
            F.lit("create the key on the target or choose other key columns").alias("suggestion"),
        )
    )


def _name_issues(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.char_length("target_table") > shapes.MAX_TARGET_NAME).select(
        "task",
        F.lit("<target_table>").alias("column_name"),
        F.lit("-").alias("source"),
        F.col("target_table").alias("target"),
        F.lit("TARGET_NAME_TOO_LONG").alias("rule"),
        F.lit("the staging name would pass 64 characters").alias("detail"),
        F.lit("shorten the target name to at most 37 characters").alias("suggestion"),
    )


def mapping_issues(
    tasks: DataFrame, source_columns: DataFrame, target_columns: DataFrame, target_keys: DataFrame
) -> DataFrame:
    """All issues of all tasks as one table; nothing stops at the first problem."""
    keys = _key_columns(tasks)
    parts = [
        _name_issues(tasks),
        _column_issues(source_columns, target_columns, keys),
        _unmapped_issues(source_columns, target_columns),
        _key_column_issues(keys, source_columns, target_columns),
        _unique_key_issues(tasks, target_keys),
    ]
    result = parts[0].select(*ISSUE_COLUMNS)
    for part in parts[1:]:
        result = result.unionByName(part.select(*ISSUE_COLUMNS))
    return result


def range_check_plan(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Bare NUMBER columns whose values must be scanned, with the target's (p,s).

    No rows means no scan is needed.
    """
    t = F.col("t")
    return (
        align_columns(shapes.with_shape(source_columns), target_columns)
        .filter(
            (F.col("shape.support") == "needs_precision")
            & (F.lower(t["data_type"]) == "decimal")
            & shapes.is_decimal_shape(t["precision"], t["scale"])
        )
        .select("task", "column_name", t["precision"].alias("precision"), t["scale"].alias("scale"))
    )


def range_verdict(requested: DataFrame, measured: DataFrame) -> DataFrame:
    """Judge range-check results: each requested column exactly once, no invalid row.

    ``requested``: task, column_name, precision, scale. ``measured``: task, column_name,
    invalid_rows. Results are counted before the join, so repeats never multiply rows.
    """
    wanted = requested.select(
        "task", F.upper("column_name").alias("name_key"), "precision", "scale"
    )
    seen = (
        measured.groupBy("task", F.upper("column_name").alias("name_key"))
        .agg(F.count("*").alias("results"), F.max("invalid_rows").alias("invalid_rows"))
    )
    verdict = (
        F.when(F.col("precision").isNull(), "NOT_REQUESTED")
        .when(F.col("results").isNull(), "NOT_MEASURED")
        .when(F.col("results") > 1, "MEASURED_TWICE")
        .when(F.col("invalid_rows") > 0, "OUT_OF_RANGE")
        .otherwise("OK")
    )
    return wanted.join(seen, _ALIGN, "full_outer").select(
        "task",
        F.col("name_key").alias("column_name"),
        "precision",
        "scale",
        "invalid_rows",
        verdict.alias("verdict"),
    )
