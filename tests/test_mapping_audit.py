"""Mapping audit on the acceptance tables of the copy contract."""

import pytest

from tableferry.operators import mapping_audit, range_audit

SOURCE = "task string, ordinal bigint, column_name string, type_name string, precision bigint, scale bigint, length bigint, fsp bigint"
TARGET = (
    "task string, ordinal bigint, column_name string, column_type string, data_type string, precision bigint, scale bigint, "
    "length bigint, datetime_precision bigint, nullable boolean, character_set string, default_value string, extra string"
)


def source(spark, *rows):
    return spark.createDataFrame([("t", i + 1, *r) for i, r in enumerate(rows)], SOURCE)


def number(name, p=None, s=None):
    return (name, "NUMBER", p, s, None, None)


def text(name, n, kind="VARCHAR2"):
    return (name, kind, None, None, n, None)


def stamp(name, fsp):
    return (name, "TIMESTAMP", None, None, None, fsp)


def decimal(name, p, s, nullable=True, **more):
    return dict(name=name, kind="decimal", shown=f"decimal({p},{s})", p=p, s=s, nullable=nullable, **more)


def varchar(name, n, charset="utf8mb4", nullable=True, **more):
    return dict(name=name, kind="varchar", shown=f"varchar({n})", n=n, charset=charset, nullable=nullable, **more)


def datetime_(name, f, nullable=True):
    return dict(name=name, kind="datetime", shown=f"datetime({f})", f=f, nullable=nullable)


def other(name, kind, nullable=True, **more):
    return dict(name=name, kind=kind, shown=kind, nullable=nullable, **more)


def target(spark, *rows):
    data = [
        ("t", i + 1, r["name"], r["shown"], r["kind"], r.get("p"), r.get("s"), r.get("n"), r.get("f"), r["nullable"],
         r.get("charset"), r.get("default"), r.get("extra", ""))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, TARGET)


def keys(spark, *lists):
    return spark.createDataFrame([("t", f"uk{i}", list(k)) for i, k in enumerate(lists)], "task string, key_name string, key_columns array<string>")


def tasks(spark, key=("ROW_ID",), name="M"):
    return spark.createDataFrame([("t", name, list(key))], "task string, target_table string, key_columns array<string>")


def rules(spark, src, tgt, key=("ROW_ID",), unique=(("ROW_ID",),), name="M"):
    found = mapping_audit.mapping_issues(tasks(spark, key, name), src, tgt, keys(spark, *unique)).collect()
    return sorted((r["column_name"], r["rule"]) for r in found)


ID = decimal("ROW_ID", 8, 0, nullable=False)


def test_nine_shapes_pass(spark):
    src = source(spark, number("row_id", 8, 0), number("N_REG", 38, 2), number("N_FRAC", 4, 6), number("N_NEG", 8, -2), number("N_BARE"),
                 text("V", 10), text("NV", 10, "NVARCHAR2"), text("C", 10, "CHAR"), text("NC", 10, "NCHAR"),
                 ("D", "DATE", None, None, None, None), stamp("TS0", 0), stamp("TS3", 3), stamp("TS6", 6))
    tgt = target(spark, ID, decimal("N_REG", 38, 2), decimal("N_FRAC", 6, 6), decimal("N_NEG", 10, 0), decimal("N_BARE", 20, 4),
                 varchar("V", 40), varchar("NV", 10), varchar("C", 40), varchar("NC", 10), datetime_("D", 0), datetime_("TS0", 6),
                 datetime_("TS3", 6), datetime_("TS6", 6))
    assert rules(spark, src, tgt) == []
    plan = mapping_audit.range_check_plan(src, tgt).collect()
    assert [(r["column_name"], r["precision"], r["scale"]) for r in plan] == [("N_BARE", 20, 4)]


def test_eight_rejections_at_once(spark):
    src = source(spark, number("ROW_ID", 8, 0), ("BF", "BINARY_FLOAT", None, None, None, None), ("BD", "BINARY_DOUBLE", None, None, None, None),
                 ("PAYLOAD", "CLOB", None, None, None, None), text("C_CHAR", 10, "CHAR"), number("N_TOO_WIDE", 38, -30),
                 number("N_TOO_SCALE", 4, 35), number("N_MISSING", 8, 0), ("D_WRONG", "DATE", None, None, None, None))
    tgt = target(spark, ID, other("BF", "double"), other("BD", "double"), other("PAYLOAD", "text"),
                 other("C_CHAR", "char", charset="utf8mb4"), decimal("N_TOO_WIDE", 65, 0), decimal("N_TOO_SCALE", 35, 30),
                 varchar("D_WRONG", 30), other("EXTRA", "int"))
    assert rules(spark, src, tgt) == [
        ("BD", "TYPE_NOT_LISTED"), ("BF", "TYPE_NOT_LISTED"), ("C_CHAR", "TEXT_TARGET_NOT_VARCHAR"),
        ("D_WRONG", "TIME_TARGET_NOT_DATETIME"), ("N_MISSING", "TARGET_MISSING"), ("N_TOO_SCALE", "DECIMAL_UNREPRESENTABLE"),
        ("N_TOO_WIDE", "DECIMAL_UNREPRESENTABLE"), ("PAYLOAD", "TYPE_NOT_LISTED"),
    ]


def test_no_scan_planned_without_bare_numbers(spark):
    src = source(spark, number("ROW_ID", 8, 0), stamp("TS", 9))
    tgt = target(spark, ID, datetime_("TS", 6))
    assert rules(spark, src, tgt) == [("TS", "FSP_TOO_PRECISE")]
    assert mapping_audit.range_check_plan(src, tgt).collect() == []


@pytest.mark.parametrize(
    "p, s, rule",
    [(18, 4, None), (20, 6, None), (18, 3, "SCALE_SHORT"), (17, 4, "INTEGER_SHORT"), (10, 2, "SCALE_AND_INTEGER_SHORT"),
     (20, 8, "INTEGER_SHORT"), (17, 3, None), (3, 5, "INTEGER_SHORT")],
)
def test_decimal_lower_bound(spark, p, s, rule):
    tgt = target(spark, ID, decimal("N", p, s))
    want = 18 if (p, s) != (17, 3) else 17
    src = source(spark, number("ROW_ID", 8, 0), number("N", want, 4 if want == 18 else 3))
    assert rules(spark, src, tgt) == ([("N", rule)] if rule else [])


def test_text_rules_are_reported_separately(spark):
    src = source(spark, number("ROW_ID", 8, 0), text("V", 10))
    assert rules(spark, src, target(spark, ID, varchar("V", 9, "latin1"))) == [("V", "TEXT_CHARSET"), ("V", "TEXT_TOO_SHORT")]


def test_repeated_source_column(spark):
    src = source(spark, number("ROW_ID", 8, 0), text("V", 10), text("v", 10))
    assert rules(spark, src, target(spark, ID, varchar("V", 10))) == [("v", "SOURCE_REPEATED")]


def test_missing_target_still_reports_the_type(spark):
    src = source(spark, number("ROW_ID", 8, 0), ("P", "CLOB", None, None, None, None), number("N"))
    assert rules(spark, src, target(spark, ID)) == [
        ("N", "NUMBER_SHAPE_UNKNOWN"), ("N", "TARGET_MISSING"), ("P", "TARGET_MISSING"), ("P", "TYPE_NOT_LISTED")
    ]


def test_nullability_and_unmapped_columns(spark):
    src = source(spark, number("ROW_ID", 8, 0), text("V", 10))
    tgt = target(spark, decimal("ROW_ID", 8, 0, nullable=True), varchar("V", 10, nullable=False), other("NEEDED", "int", nullable=False),
                 other("DEFAULTED", "int", nullable=False, default="0"), other("AUTO", "int", nullable=False, extra="auto_increment"))
    assert rules(spark, src, tgt) == [("NEEDED", "REQUIRED_UNMAPPED"), ("ROW_ID", "KEY_NULLABLE"), ("V", "TARGET_NOT_NULLABLE")]


def test_key_must_match_a_unique_key_as_a_set(spark):
    src = source(spark, number("ROW_ID", 8, 0), number("SUB", 8, 0))
    tgt = target(spark, ID, decimal("SUB", 8, 0, nullable=False))
    assert rules(spark, src, tgt, ("SUB", "row_id"), (("ROW_ID", "SUB"),)) == []
    assert ("<primary_key>", "KEY_NOT_UNIQUE") in rules(spark, src, tgt, ("ROW_ID",), (("ROW_ID", "SUB"),))
    assert ("<primary_key>", "KEY_NOT_UNIQUE") in rules(spark, src, tgt, ("ROW_ID", "SUB"), ())


def test_key_must_be_selected(spark):
    src = source(spark, number("OTHER", 8, 0))
    tgt = target(spark, ID, decimal("OTHER", 8, 0))
    assert rules(spark, src, tgt) == [("ROW_ID", "KEY_NOT_SELECTED"), ("ROW_ID", "REQUIRED_UNMAPPED")]


def test_target_name_length(spark):
    src, tgt = source(spark, number("ROW_ID", 8, 0)), target(spark, ID)
    assert rules(spark, src, tgt, name="X" * 37) == []
    assert rules(spark, src, tgt, name="X" * 38) == [("<target_table>", "TARGET_NAME_TOO_LONG")]


def test_bare_number_targets(spark):
    src = source(spark, number("ROW_ID", 8, 0), number("A"), number("B"))
    assert rules(spark, src, target(spark, ID, other("A", "int"), decimal("B", 66, 0))) == [
        ("A", "NUMBER_TARGET_NOT_DECIMAL"), ("B", "DECIMAL_SHAPE_INVALID")
    ]


def test_one_scan_for_the_range_check(spark):
    values = ["1.2345", "1.23456", "-99999999999999.9999", "0", None]
    df = spark.createDataFrame([(v,) for v in values], "N_BARE string")
    row = range_audit.range_audit(df, [range_audit.RangeCheck("N_BARE", 20, 4)]).first()
    assert (row["scanned_rows"], row["invalid_rows"]) == (5, 1)
    typed = df.selectExpr("CAST(N_BARE AS DECIMAL(38,6)) AS N_BARE")
    assert range_audit.range_audit(typed, [range_audit.RangeCheck("N_BARE", 20, 4)]).first()["invalid_rows"] == 1
    empty = range_audit.range_audit(df.limit(0), [range_audit.RangeCheck("N_BARE", 20, 4)]).first()
    assert (empty["scanned_rows"], empty["invalid_rows"]) == (0, 0)
    assert range_audit.range_audit(df, []).collect() == []


@pytest.mark.parametrize("precision, scale, invalid", [(38, 0, 1), (2, 0, 2), (38, 2, 0), (4, 2, 1), (3, 1, 2)])
def test_range_bounds_on_decimals(spark, precision, scale, invalid):
    df = spark.sql("SELECT CAST(v AS DECIMAL(38,2)) AS v FROM VALUES ('0.25'), ('-100'), (NULL), ('99') AS t(v)")
    assert range_audit.range_audit(df, [range_audit.RangeCheck("v", precision, scale)]).first()["invalid_rows"] == invalid


def test_range_verdicts(spark):
    asked = spark.createDataFrame([("t", c, 20, 4) for c in "ABCD"], "task string, column_name string, precision bigint, scale bigint")
    got = spark.createDataFrame([("t", "a", 0), ("t", "B", 3), ("t", "C", 0), ("t", "C", 0), ("t", "Z", 0)], "task string, column_name string, invalid_rows bigint")
    verdicts = {r["column_name"]: r["verdict"] for r in mapping_audit.range_verdict(asked, got).collect()}
    assert verdicts == {"A": "OK", "B": "OUT_OF_RANGE", "C": "MEASURED_TWICE", "D": "NOT_MEASURED", "Z": "NOT_REQUESTED"}


def test_rejects_name_column_and_value(spark):
    df = spark.createDataFrame([(1, "12.345", "2026-02-30 00:00:00", "甲乙丙"), (2, "1234", "2026-02-28 00:00:00", "ab"), (3, None, None, None), (4, "x", "0000-01-01 00:00:00", "")],
                               "id int, n string, d string, v string")
    rules_ = [range_audit.decimal_target_rule("n", 4, 2), range_audit.datetime_target_rule("d"), range_audit.varchar_target_rule("v", 2)]
    found = range_audit.reject_rows(df, ["id"], rules_)
    got = sorted(tuple(r) for r in found.withColumn("code", range_audit.target_code(found["reason"])).collect())
    assert got == [
        (1, "d", "2026-02-30 00:00:00", "BAD_DATETIME", 1292), (1, "n", "12.345", "WOULD_ROUND", 1265), (1, "v", "甲乙丙", "TOO_LONG", 1406),
        (2, "n", "1234", "OUT_OF_RANGE", 1264), (4, "d", "0000-01-01 00:00:00", "BAD_DATETIME", 1292), (4, "n", "x", "NOT_A_NUMBER", 1366),
    ]
