"""Value rules against the 66 golden cases."""

import pytest
from pyspark.sql import functions as F

from tableferry.functions import canon

# Canonical numbers that pass unchanged.
NUMBERS = [
    "0", "100", "0.5", "-0.01", "1.23", "12345678901234567890123456789012345678",
    "-12345678901234567890123456789012345678", "1234567890123456789012345678.0123456789",
    "0.000001", "-0.000001", "0.009999", "12300", "9999999900", "-9999999900", "1.2345",
    "-99999999999999.9999",
]
# Texts that are no canonical number.
NOT_NUMBERS = ["-0", "0.000", "1.230", "007", ".5", "1,23", "1E5", "1.5E+10", "+1", "", " 1", "1."]
# Date components and their text.
DATES = [
    ((2026, 8, 13, 14, 35, 9), "2026-08-13 14:35:09"),
    ((2026, 8, 13, 0, 0, 0), "2026-08-13 00:00:00"),
    ((1999, 12, 31, 23, 59, 59), "1999-12-31 23:59:59"),
    ((2000, 1, 1, 0, 0, 0), "2000-01-01 00:00:00"),
    ((2024, 2, 29, 12, 0, 0), "2024-02-29 12:00:00"),
    ((2000, 2, 29, 0, 0, 0), "2000-02-29 00:00:00"),
    ((1, 1, 1, 0, 0, 0), "0001-01-01 00:00:00"),
    ((9999, 12, 31, 23, 59, 59), "9999-12-31 23:59:59"),
    ((0, 1, 1, 0, 0, 0), None),
    ((-4712, 1, 1, 0, 0, 0), None),
    ((10000, 1, 1, 0, 0, 0), None),
]
# Timestamp components and their text.
STAMPS = [
    ((2026, 8, 13, 14, 35, 9, 120000000), "2026-08-13 14:35:09.120000"),
    ((2026, 8, 13, 14, 35, 9, 0), "2026-08-13 14:35:09.000000"),
    ((2026, 8, 13, 14, 35, 9, 999999000), "2026-08-13 14:35:09.999999"),
    ((2026, 8, 13, 0, 0, 0, 0), "2026-08-13 00:00:00.000000"),
    ((1999, 12, 31, 23, 59, 59, 0), "1999-12-31 23:59:59.000000"),
    ((2000, 1, 1, 0, 0, 0, 0), "2000-01-01 00:00:00.000000"),
    ((2024, 2, 29, 12, 0, 0, 0), "2024-02-29 12:00:00.000000"),
    ((2000, 2, 29, 0, 0, 0, 0), "2000-02-29 00:00:00.000000"),
    ((1, 1, 1, 0, 0, 0, 0), "0001-01-01 00:00:00.000000"),
    ((9999, 12, 31, 23, 59, 59, 999999000), "9999-12-31 23:59:59.999999"),
    ((44, 3, 15, 0, 0, 0, 0), "0044-03-15 00:00:00.000000"),
    ((999, 12, 31, 23, 59, 59, 0), "0999-12-31 23:59:59.000000"),
    ((0, 1, 1, 0, 0, 0, 0), None),
    ((-4712, 1, 1, 0, 0, 0, 0), None),
    ((10000, 1, 1, 0, 0, 0, 0), None),
    ((2026, 8, 13, 14, 35, 9, 1500), None),
]
# Texts that travel unchanged, and NULL.
TEXTS = [
    "资产净值合计", "AB        ", 'a"b\\c\td\ne', "甲乙丙丁戊己庚辛壬癸", "资产净值合计", "AB        ",
    "甲乙        ", "甲乙        ", "          ", "甲乙丙丁戊己庚辛壬癸", None,
]


def test_numbers(spark):
    rows = [(n, True) for n in NUMBERS] + [(n, False) for n in NOT_NUMBERS] + [("1\n", False), ("1.5\n", False)]
    df = spark.createDataFrame(rows, "n string, good boolean")
    checked = df.select("n", "good", canon.is_canonical_number(F.col("n")).alias("ok"), canon.canon_number(F.col("n")).alias("c"))
    for row in checked.collect():
        assert row["ok"] == row["good"], row
        assert row["c"] == (row["n"] if row["good"] else None)


def test_null_number_bypasses(spark):
    df = spark.createDataFrame([(None,)], "n string")
    assert df.select(canon.is_canonical_number(F.col("n"))).first()[0] is None


def test_texts_travel_unchanged(spark):
    from tableferry.operators.numbering import canonical_cells

    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0][0] for r in df.select(canonical_cells(df)).collect()] == TEXTS


def test_dates(spark):
    parts = ["y", "mo", "d", "h", "mi", "s"]
    extra = [((2023, 2, 29, 0, 0, 0), None), ((2023, 1, 1, 24, 0, 0), None), ((2023, 1, 1, 0, 0, 60), None)]
    rows = [(*c, e) for c, e in DATES + extra]
    df = spark.createDataFrame(rows, ", ".join(f"{p} int" for p in parts) + ", e string")
    for row in df.withColumn("got", canon.canon_date(*[F.col(p) for p in parts])).collect():
        assert row["got"] == row["e"], row


def test_timestamps(spark):
    parts = ["y", "mo", "d", "h", "mi", "s", "ns"]
    extra = [((2023, 1, 1, 0, 0, 0, 1_000_000_000), None), ((2023, 1, 1, 0, 0, 0, 1000), "2023-01-01 00:00:00.000001")]
    rows = [(*c, e) for c, e in STAMPS + extra]
    df = spark.createDataFrame(rows, ", ".join(f"{p} int" for p in parts) + ", e string")
    for row in df.withColumn("got", canon.canon_timestamp(*[F.col(p) for p in parts])).collect():
        assert row["got"] == row["e"], row


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("1.2300", "decimal(10,4)", "1.23"), ("100", "decimal(10,0)", "100"), ("100.00", "decimal(10,2)", "100"),
        ("0.00", "decimal(10,2)", "0"), ("-0.010", "decimal(10,3)", "-0.01"), ("-0.00", "decimal(10,2)", "0"),
        ("0.0000000001", "decimal(38,10)", "0.0000000001"), ("1200", "decimal(38,0)", "1200"),
    ],
)
def test_number_text(spark, text, kind, expected):
    df = spark.range(1).select(F.lit(text).cast(kind).alias("d"))
    assert df.select(canon.number_text(F.col("d"))).first()[0] == expected


@pytest.mark.parametrize(
    "text, precision, scale, fits",
    [
        ("0", 1, 1, True), ("0.5", 1, 1, True), ("1.5", 1, 1, False), ("-99999999999999.9999", 18, 4, True),
        ("1.23456", 20, 4, False), ("100", 2, 0, False), ("9" * 65, 65, 0, True), ("9" * 66, 65, 0, False),
    ],
)
def test_fits_decimal(spark, text, precision, scale, fits):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(canon.fits_decimal(F.col("t"), precision, scale)).first()[0] is fits


def test_time_columns_to_text(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '0044-03-15 01:02:03.120000' AS t")
    row = df.select(canon.date_text(F.col("t")).alias("d"), canon.timestamp_text(F.col("t")).alias("s")).first()
    assert (row["d"], row["s"]) == ("0044-03-15 01:02:03", "0044-03-15 01:02:03.120000")


def test_no_time_zone_anywhere(spark):
    """A wall-clock time that a session time zone skips stays as it is."""
    from tableferry.functions import runs
    from tableferry.operators.profile import profile_time

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.5' AS t, '20240310023000_0a1b2c' AS r")
        row = df.select(
            canon.date_text(F.col("t")).alias("d"), canon.timestamp_text(F.col("t")).alias("s"),
            canon.date_text(runs.run_id_time(F.col("r"))).alias("r"),
            canon.canon_date(*[F.lit(v) for v in (2024, 3, 10, 2, 30, 0)]).alias("c"),
        ).first()
        assert tuple(row) == ("2024-03-10 02:30:00", "2024-03-10 02:30:00.500000", "2024-03-10 02:30:00", "2024-03-10 02:30:00")
        kinds = {r["kind"]: r["value"] for r in profile_time(df, ["t"]).collect()}
        assert kinds == {"min_val": "2024-03-10 02:30:00.500000", "max_val": "2024-03-10 02:30:00.500000", "with_time_cnt": "1", "null_cnt": "0"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_digit_checks_agree_with_decimal_arithmetic(spark):
    import random
    from decimal import Decimal

    from tableferry.operators.range_audit import RangeCheck, range_audit

    pick = random.Random(17)
    values = [Decimal(pick.randrange(-10**pick.randrange(1, 20), 10**pick.randrange(1, 20))).scaleb(-pick.randrange(0, 9)) for _ in range(500)]
    df = spark.createDataFrame([(str(v.quantize(Decimal(1).scaleb(-8))),) for v in values], "v string").selectExpr("CAST(v AS DECIMAL(38,8)) AS n")
    texts = df.select("n", canon.number_text(F.col("n")).alias("t"))
    for precision, scale in ((10, 2), (5, 5), (20, 8), (3, 0), (38, 4)):
        bound = Decimal(10) ** (precision - scale)
        expected = sum(1 for v in values if v != v.quantize(Decimal(1).scaleb(-scale)) or abs(v) >= bound)
        audit = range_audit(texts, [RangeCheck("n", precision, scale), RangeCheck("t", precision, scale)]).collect()
        assert [r["invalid_rows"] for r in audit] == [expected, expected], (precision, scale)
