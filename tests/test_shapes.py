"""Target shape derivation, target DDL, and the loop between DDL and audit."""

import pytest
from pyspark.sql import functions as F

from tableferry.functions import shapes
from tableferry.operators import ddl, mapping_audit
from tableferry.functions.shapes import with_shape

SCHEMA = "task string, ordinal bigint, column_name string, type_name string, precision bigint, scale bigint, length bigint, fsp bigint"

# Source column parts and the shape or rejection they derive.
ACCEPTED = [
    (("NUMBER", 18, 4, None, None), "DECIMAL(18,4)"),
    (("NUMBER", 38, 0, None, None), "DECIMAL(38,0)"),
    (("NUMBER", 4, 6, None, None), "DECIMAL(6,6)"),
    (("NUMBER", 10, -5, None, None), "DECIMAL(15,0)"),
    (("NUMBER", 38, -27, None, None), "DECIMAL(65,0)"),
    (("NUMBER", 65, 30, None, None), "DECIMAL(65,30)"),
    (("VARCHAR2", None, None, 50, None), "VARCHAR(50)"),
    (("NVARCHAR2", None, None, 20, None), "VARCHAR(20)"),
    (("CHAR", None, None, 30, None), "VARCHAR(30)"),
    (("NCHAR", None, None, 10, None), "VARCHAR(10)"),
    (("DATE", None, None, None, None), "DATETIME(0)"),
    (("TIMESTAMP", None, None, None, 0), "DATETIME(6)"),
    (("TIMESTAMP", None, None, None, 3), "DATETIME(6)"),
    (("timestamp", None, None, None, 6), "DATETIME(6)"),
]
REJECTED = [
    (("NUMBER", 38, -30, None, None), "DECIMAL_UNREPRESENTABLE"),
    (("NUMBER", 4, 35, None, None), "DECIMAL_UNREPRESENTABLE"),
    (("NUMBER", 66, 0, None, None), "DECIMAL_UNREPRESENTABLE"),
    (("NUMBER", 9223372036854775807, -9223372036854775808, None, None), "DECIMAL_UNREPRESENTABLE"),
    (("NUMBER", 38, None, None, None), "NUMBER_HALF_DECLARED"),
    (("NUMBER", None, 2, None, None), "NUMBER_HALF_DECLARED"),
    (("VARCHAR2", None, None, None, None), "LENGTH_MISSING"),
    (("TIMESTAMP", None, None, None, 7), "FSP_TOO_PRECISE"),
    (("TIMESTAMP", None, None, None, None), "FSP_MISSING"),
    (("CLOB", None, None, None, None), "TYPE_NOT_LISTED"),
    (("BINARY_DOUBLE", None, None, None, None), "TYPE_NOT_LISTED"),
    (("TIMESTAMP WITH TIME ZONE", None, None, None, 6), "TYPE_NOT_LISTED"),
]


def columns(spark, parts):
    return spark.createDataFrame([("t", i + 1, f"C{i}", *p) for i, p in enumerate(parts)], SCHEMA)


def test_accepted_shapes(spark):
    df = with_shape(columns(spark, [p for p, _ in ACCEPTED])).orderBy("ordinal")
    got = df.select(shapes.shape_text().alias("s"), "shape.support").collect()
    assert [r["s"] for r in got] == [e for _, e in ACCEPTED]
    assert {r["support"] for r in got} == {"ok"}


def test_rejected_shapes(spark):
    df = with_shape(columns(spark, [p for p, _ in REJECTED])).orderBy("ordinal")
    got = df.select("shape.rejection", "shape.support").collect()
    assert [r["rejection"] for r in got] == [e for _, e in REJECTED]
    assert {r["support"] for r in got} == {"unsupported"}


def test_bare_number_needs_precision(spark):
    row = with_shape(columns(spark, [("NUMBER", None, None, None, None)])).select("shape.support", "source").first()
    assert (row["support"], row["source"]) == ("needs_precision", "NUMBER(?,?)")


@pytest.mark.parametrize("kind, fsp, expected", [("DATE", None, True), ("timestamp", 6, True), ("TIMESTAMP", 7, False), ("TIMESTAMP", None, False), ("NUMBER", None, False)])
def test_date_filter(spark, kind, fsp, expected):
    df = spark.createDataFrame([(kind, fsp)], "k string, f bigint")
    assert df.select(shapes.may_filter_by_date(F.col("k"), F.col("f"))).first()[0] is expected


def tasks(spark, key=("C0",), name="TARGET"):
    return spark.createDataFrame([("t", name, list(key))], "task string, target_table string, key_columns array<string>")


def test_ddl_lists_every_bad_column(spark):
    row = ddl.target_ddl(tasks(spark, ("C0", "GONE")), columns(spark, [p for p, _ in REJECTED])).first()
    assert row["ddl"] is None
    assert row["errors"].count("): ") == len(REJECTED) + 1
    assert "GONE (<missing>)" in row["errors"]


def test_ddl_text(spark):
    source = columns(spark, [("NUMBER", 8, 0, None, None), ("NUMBER", None, None, None, None), ("CHAR", None, None, 10, None)])
    row = ddl.target_ddl(tasks(spark, name="odd`name"), source).first()
    assert row["errors"] is None
    assert row["ddl"].splitlines()[1:] == [
        "-- declare (p,s) for: C1",
        "CREATE TABLE `odd``name` (",
        "  `C0` DECIMAL(8,0) NOT NULL,",
        "  `C1` DECIMAL(<p>,<s>) NULL,",
        "  `C2` VARCHAR(10) NULL,",
        "  PRIMARY KEY (`C0`)",
        ") DEFAULT CHARSET=utf8mb4;",
    ]


def test_declared_precision(spark):
    source = columns(spark, [("NUMBER", 8, 0, None, None), ("NUMBER", None, None, None, None)])
    hinted = source.withColumn("hint_precision", F.lit(20).cast("bigint")).withColumn("hint_scale", F.lit(4).cast("bigint"))
    assert "`C1` DECIMAL(20,4) NULL" in ddl.target_ddl(tasks(spark), hinted).first()["ddl"]
    bad = hinted.withColumn("hint_precision", F.lit(66).cast("bigint"))
    assert "DECIMAL(66,4)" in ddl.target_ddl(tasks(spark), bad).first()["errors"]


def test_generated_ddl_passes_the_audit(spark):
    """The target that the DDL creates has no issue with the source it came from."""
    source = columns(spark, [("NUMBER", 8, 0, None, None)] + [p for p, _ in ACCEPTED])
    lines = ddl.target_ddl(tasks(spark), source).select(F.explode(F.split("ddl", "\n")).alias("line"))
    parts = r"^  `(.+)` (([A-Z]+)\(([0-9]+)(?:,([0-9]+))?\)) (NOT NULL|NULL),$"
    number = [F.regexp_extract("line", parts, i) for i in range(7)]
    kind = F.lower(number[3])
    target = lines.filter(F.col("line").rlike(parts)).select(
        F.lit("t").alias("task"), F.lit(1).cast("bigint").alias("ordinal"), number[1].alias("column_name"),
        F.lower(number[2]).alias("column_type"), kind.alias("data_type"),
        F.when(kind == "decimal", number[4].try_cast("bigint")).alias("precision"),
        F.when(kind == "decimal", number[5].try_cast("bigint")).alias("scale"),
        F.when(kind == "varchar", number[4].try_cast("bigint")).alias("length"),
        F.when(kind == "datetime", number[4].try_cast("bigint")).alias("datetime_precision"),
        (number[6] == "NULL").alias("nullable"),
        F.when(kind == "varchar", "utf8mb4").alias("character_set"),
        F.lit(None).cast("string").alias("default_value"), F.lit("").alias("extra"),
    )
    keys = spark.createDataFrame([("t", "PRIMARY", ["C0"])], "task string, key_name string, key_columns array<string>")
    assert target.count() == len(ACCEPTED) + 1
    assert mapping_audit.mapping_issues(tasks(spark), source, target, keys).collect() == []


def test_staging_layout(spark):
    from pyspark.sql import types as T

    schema = ddl.staging_schema([("A", "decimal", 8, 0), ("B", "decimal", 65, 30), ("C", "varchar", None, None), ("D", "datetime", None, None)])
    assert [f.dataType for f in schema] == [T.DecimalType(8, 0), T.StringType(), T.StringType(), T.TimestampNTZType()]
    assert all(f.nullable for f in schema)
