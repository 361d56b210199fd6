"""Source tables, table lists and column metadata."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions import runs as run_functions
from tableferry.functions import shapes
from tableferry.spec import TaskSpec, apply_spec

SOURCE_COLUMN_SCHEMA = (
    "task string, ordinal bigint, column_name string, type_name string, precision bigint, "
    "scale bigint, length bigint, fsp bigint"
)
TARGET_COLUMN_SCHEMA = (
    "task string, ordinal bigint, column_name string, column_type string, data_type string, "
    "precision bigint, scale bigint, length bigint, datetime_precision bigint, nullable boolean, "
    "character_set string, default_value string, extra string"
)


@dataclass(frozen=True)
class SourceRef:
    """Where a table lives: `catalog` (table name), `path` (files) or `jdbc` (table or query)."""

    kind: str
    name: str
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def for_spec(cls, spec: TaskSpec, kind: str = "catalog", **options: str) -> "SourceRef":
        name = spec.source_name() if kind == "jdbc" else f"{spec.owner}.{spec.table}"
        return cls(kind, name, options=options)


def read_table(spark: SparkSession, ref: SourceRef | Callable[[SparkSession], DataFrame]) -> DataFrame:
    """The table as a lazy DataFrame; any callable that returns one works as a source."""
    if callable(ref):
        return ref(spark)
    if ref.kind == "catalog":
        return spark.table(ref.name)
    if ref.kind == "path":
        return spark.read.format(ref.format).options(**ref.options).load(ref.name)
    if ref.kind == "jdbc":
        from tableferry.sources.jdbc import read_jdbc

        return read_jdbc(spark, ref.name, ref.options)
    raise ValueError(f"unknown source kind {ref.kind!r}")


def read_source(
    spark: SparkSession, ref, spec: TaskSpec, params: Mapping[str, str] | None = None
) -> DataFrame:
    """The bounded scan of one task: filters and the column list reach the source's own scan."""
    return apply_spec(read_table(spark, ref), spec, params)


def list_tables(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """Tables of the catalog as ``owner, table_name``, ordered by both.

    Catalog listings live on the driver, so this is meant for one catalog's names; dictionary
    tables read over JDBC go through `dictionary_tables` instead.
    """
    names = databases or [d.name for d in spark.catalog.listDatabases()]
    rows = [
        (name, t.name) for name in names for t in spark.catalog.listTables(name) if not t.isTemporary
    ]
    return spark.createDataFrame(rows, "owner string, table_name string").orderBy("owner", "table_name")


def dictionary_tables(dictionary: DataFrame, owner: str | None = None) -> DataFrame:
    """Table list from a dictionary view with OWNER and TABLE_NAME."""
    rows = dictionary.select(F.col("owner"), F.col("table_name"))
    if owner is not None:
        rows = rows.filter(F.col("owner") == owner)
    return rows.orderBy("owner", "table_name")


def dictionary_columns(dictionary: DataFrame) -> DataFrame:
    """Source column metadata of all tables at once from a dictionary view.

    Takes OWNER, TABLE_NAME, COLUMN_ID, COLUMN_NAME, DATA_TYPE, DATA_PRECISION, DATA_SCALE,
    CHAR_LENGTH, NULLABLE. The dictionary writes `TIMESTAMP(6)` with the digits in DATA_SCALE.
    """
    kind = F.regexp_replace(F.upper("data_type"), r"^TIMESTAMP\([0-9]+\)$", "TIMESTAMP")
    is_number, is_stamp = kind == "NUMBER", kind == "TIMESTAMP"
    return dictionary.select(
        F.concat_ws(".", "owner", "table_name").alias("task"),
        F.col("column_id").cast("bigint").alias("ordinal"),
        "column_name",
        kind.alias("type_name"),
        F.when(is_number, F.col("data_precision")).cast("bigint").alias("precision"),
        F.when(is_number, F.col("data_scale")).cast("bigint").alias("scale"),
        F.when(kind.isin(*shapes.TEXT_TYPES), F.col("char_length")).cast("bigint").alias("length"),
        F.when(is_stamp, F.col("data_scale")).cast("bigint").alias("fsp"),
        (F.col("nullable") == "Y").alias("nullable"),
    )


def _source_shape(kind: T.DataType) -> tuple:
    """(type_name, precision, scale, length, fsp) of a Spark type read from the source."""
    if isinstance(kind, T.DecimalType):
        return "NUMBER", kind.precision, kind.scale, None, None
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    for spark_type, digits in whole.items():
        if isinstance(kind, spark_type):
            return "NUMBER", digits, 0, None, None
    if isinstance(kind, (T.VarcharType, T.CharType)):
        return "VARCHAR2" if isinstance(kind, T.VarcharType) else "CHAR", None, None, kind.length, None
    if isinstance(kind, T.StringType):
        return "VARCHAR2", None, None, None, None
    if isinstance(kind, T.DateType):
        return "DATE", None, None, None, None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP", None, None, None, 6
    return kind.simpleString().upper(), None, None, None, None


def describe(df: DataFrame, task: str) -> DataFrame:
    """Source column metadata of a query from its schema alone: no row is read, no job runs."""
    rows = [
        (task, i + 1, f.name, *_source_shape(f.dataType)) for i, f in enumerate(df.schema.fields)
    ]
    out = df.sparkSession.createDataFrame(rows, SOURCE_COLUMN_SCHEMA)
    return shapes.with_shape(out).select(*out.columns, F.col("shape.support").alias("support"))


def target_columns_of(df: DataFrame, task: str) -> DataFrame:
    """Target column metadata of a Spark table used as the target."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        kind = f.dataType
        if isinstance(kind, T.DecimalType):
            shape = (f"decimal({kind.precision},{kind.scale})", "decimal", kind.precision, kind.scale, None, None, None)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            shape = ("datetime(6)", "datetime", None, None, None, 6, None)
        elif isinstance(kind, T.StringType):
            length = getattr(kind, "length", None) or 65535
            shape = (f"varchar({length})", "varchar", None, None, length, None, "utf8mb4")
        else:
            name = kind.simpleString()
            shape = (name, name, None, None, None, None, None)
        rows.append((task, i + 1, f.name, *shape[:2], *shape[2:6], f.nullable, shape[6], None, ""))
    return df.sparkSession.createDataFrame(rows, TARGET_COLUMN_SCHEMA)


def dictionary_target_columns(information_schema_columns: DataFrame) -> DataFrame:
    """Target column metadata of all tables from INFORMATION_SCHEMA.COLUMNS."""
    c = F.col
    return information_schema_columns.select(
        F.concat_ws(".", "table_schema", "table_name").alias("task"),
        c("ordinal_position").cast("bigint").alias("ordinal"),
        "column_name",
        "column_type",
        "data_type",
        c("numeric_precision").cast("bigint").alias("precision"),
        c("numeric_scale").cast("bigint").alias("scale"),
        c("character_maximum_length").cast("bigint").alias("length"),
        c("datetime_precision").cast("bigint").alias("datetime_precision"),
        (c("is_nullable") == "YES").alias("nullable"),
        c("character_set_name").alias("character_set"),
        c("column_default").cast("string").alias("default_value"),
        F.coalesce("extra", F.lit("")).alias("extra"),
    )


def unique_keys(index_columns: DataFrame) -> DataFrame:
    """Unique keys with their columns in index order.

    ``index_columns``: task, key_name, seq, column_name, non_unique. An index has at most a few
    columns, so the list per key is bounded.
    """
    return (
        index_columns.filter(F.col("non_unique") == 0)
        .groupBy("task", "key_name")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "column_name"))).alias("parts"))
        .select("task", "key_name", F.transform("parts", lambda p: p["column_name"]).alias("key_columns"))
    )


def orphan_staging(tables: DataFrame, live_runs: DataFrame) -> DataFrame:
    """Staging tables whose run is not live, with the run's time; nothing is dropped.

    ``tables``: table_name; ``live_runs``: run_id.
    """
    name_rule = "^(.+)__stg_(" + run_functions.RUN_ID_GRAMMAR + r")\z"
    run_id: Column = F.regexp_extract("table_name", name_rule, 2)
    return (
        tables.filter(F.col("table_name").rlike(name_rule))
        .select(
            "table_name",
            F.regexp_extract("table_name", name_rule, 1).alias("target_table"),
            run_id.alias("run_id"),
            run_functions.run_id_time(run_id).alias("started_at"),
        )
        .join(live_runs.select("run_id"), "run_id", "left_anti")
    )
