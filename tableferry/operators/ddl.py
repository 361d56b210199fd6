"""CREATE TABLE texts and staging layouts, one per task.

The columns of one table are few by nature (the target database allows 4,096), so collecting
them per task is bounded whatever the number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions import shapes


def quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def target_ddl(tasks: DataFrame, source_columns: DataFrame) -> DataFrame:
    """``task, ddl, errors``: the DDL, or every column that has no target shape.

    ``source_columns`` may carry ``hint_precision, hint_scale``, the declared shape of a bare
    NUMBER; without a hint the DDL holds a placeholder and names the column in a comment.
    """
    for hint in ("hint_precision", "hint_scale"):
        if hint not in source_columns.columns:
            source_columns = source_columns.withColumn(hint, F.lit(None).cast("bigint"))
    shape = F.col("shape")
    bare = shape["support"] == "needs_precision"
    hinted = F.col("hint_precision").isNotNull() & F.col("hint_scale").isNotNull()
    hint_text = shapes.decimal_text(F.col("hint_precision"), F.col("hint_scale"))
    hint_ok = shapes.is_decimal_shape(F.col("hint_precision"), F.col("hint_scale"))
    type_text = F.when(~bare, shapes.shape_text()).when(~hinted, "DECIMAL(<p>,<s>)").otherwise(hint_text)
    error = F.when(
        shape["rejection"].isNotNull(), F.expr(shapes.lookup("shape.rejection", 1))
    ).when(bare & hinted & ~hint_ok, F.concat(F.lit("the declared "), hint_text, F.lit(" exceeds DECIMAL(65,30)")))

    keys = F.transform("key_columns", F.upper)
    rows = (
        shapes.with_shape(source_columns)
        .join(tasks.select("task", "target_table", "key_columns"), "task")
        .withColumn("is_key", F.array_contains(keys, F.upper("column_name")))
        .select(
            "task",
            "target_table",
            "key_columns",
            F.struct(
                "ordinal",
                F.upper("column_name").alias("name_key"),
                F.concat(
                    F.lit("  "),
                    quoted(F.col("column_name")),
                    F.lit(" "),
                    type_text,
                    F.when(F.col("is_key"), " NOT NULL").otherwise(" NULL"),
                ).alias("definition"),
                F.when(
                    error.isNotNull(),
                    F.concat("column_name", F.lit(" ("), "source", F.lit("): "), error),
                ).alias("error"),
                F.when(bare & ~hinted, F.col("column_name")).alias("placeholder"),
            ).alias("c"),
        )
    )
    grouped = rows.groupBy("task", "target_table", "key_columns").agg(
        F.array_sort(F.collect_list("c")).alias("cs")
    )
    names = F.transform("cs", lambda c: c["name_key"])
    lost_keys = F.transform(
        F.filter("key_columns", lambda k: ~F.array_contains(names, F.upper(k))),
        lambda k: F.concat(k, F.lit(" (<missing>): the key column is not among the source columns")),
    )
    errors = F.concat(F.array_compact(F.transform("cs", lambda c: c["error"])), lost_keys)
    placeholders = F.array_compact(F.transform("cs", lambda c: c["placeholder"]))
    note = F.when(
        F.size(placeholders) > 0,
        F.concat(F.lit("-- declare (p,s) for: "), F.array_join(placeholders, ", "), F.lit("\n")),
    ).otherwise("")
    key_line = F.concat(
        F.lit("  PRIMARY KEY ("), F.array_join(F.transform("key_columns", quoted), ", "), F.lit(")")
    )
    body = F.array_join(F.concat(F.transform("cs", lambda c: c["definition"]), F.array(key_line)), ",\n")
    table = F.when(F.col("target_table") == "", "<target table>").otherwise(quoted(F.col("target_table")))
    ddl = F.concat(
        F.lit("-- run this yourself; the upsert relies on the primary key\n"),
        note,
        F.lit("CREATE TABLE "),
        table,
        F.lit(" (\n"),
        body,
        F.lit("\n) DEFAULT CHARSET=utf8mb4;"),
    )
    return grouped.select("task", F.array_join(errors, "; ").alias("errors"), ddl.alias("ddl")).select(
        "task",
        F.when(F.col("errors") == "", F.col("ddl")).alias("ddl"),
        F.when(F.col("errors") != "", F.col("errors")).alias("errors"),
    )


def staging_ddl(target_columns: DataFrame, run_id: Column, target_table: Column) -> DataFrame:
    """``task, ddl`` of the staging tables: target order and types, every column nullable."""
    definition = F.concat(
        F.lit("  "),
        quoted(F.col("column_name")),
        F.lit(" "),
        F.col("column_type"),
        F.when(
            F.col("character_set").isNotNull(), F.concat(F.lit(" CHARACTER SET "), "character_set")
        ).otherwise(""),
        F.lit(" NULL"),
    )
    name = F.concat(target_table, F.lit("__stg_"), run_id)
    return (
        target_columns.withColumn("staging_table", name)
        .groupBy("task", "staging_table")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", definition.alias("d")))).alias("ds"))
        .select(
            "task",
            F.concat(
                F.lit("CREATE TABLE "),
                quoted(F.col("staging_table")),
                F.lit(" (\n"),
                F.array_join(F.transform("ds", lambda d: d["d"]), ",\n"),
                F.lit("\n)"),
            ).alias("ddl"),
        )
    )


def spark_type(family: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """Spark carrier of a target shape; decimals over 38 digits travel as canonical text."""
    if family == "decimal":
        return T.DecimalType(precision, scale) if precision <= 38 else T.StringType()
    return T.TimestampNTZType() if family == "datetime" else T.StringType()


def staging_schema(columns) -> T.StructType:
    """Nullable Spark schema from ``(name, family, precision, scale)`` in target order."""
    return T.StructType(
        [T.StructField(name, spark_type(family, p, s), True) for name, family, p, s in columns]
    )
