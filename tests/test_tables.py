"""Metadata, table lists, staging names, JDBC options."""

import pytest
from pyspark.sql import functions as F

from tableferry import ColumnMapping, TaskSpec
from tableferry.functions import runs
from tableferry.sources import jdbc, tables
from tableferry.operators import spec_audit


def test_describe_runs_no_job(spark):
    df = spark.sql("SELECT CAST(1 AS DECIMAL(10,2)) AS n, 1 AS i, 'x' AS v, TIMESTAMP_NTZ '2026-01-01' AS t, DATE '2026-01-01' AS d, CAST(1 AS DOUBLE) AS f, raise_error('read') AS r")
    got = {r["column_name"]: (r["type_name"], r["precision"], r["scale"], r["fsp"], r["support"]) for r in tables.describe(df, "t").collect()}
    assert got["n"] == ("NUMBER", 10, 2, None, "ok")
    assert got["i"] == ("NUMBER", 10, 0, None, "ok")
    assert got["t"] == ("TIMESTAMP", None, None, 6, "ok")
    assert got["d"][0] == "DATE" and got["f"][4] == "unsupported" and got["v"][4] == "unsupported"


def test_catalog_tables_and_sources(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS ferry_test")
    spark.range(3).withColumnRenamed("id", "a").write.mode("overwrite").saveAsTable("ferry_test.beta")
    spark.range(3).write.mode("overwrite").saveAsTable("ferry_test.alpha")
    try:
        got = [tuple(r) for r in tables.list_tables(spark, ["ferry_test"]).collect()]
        assert got == [("ferry_test", "alpha"), ("ferry_test", "beta")]
        task = TaskSpec("ferry_test", "beta", "T", ("K",), (ColumnMapping("a", "K"),))
        assert tables.read_source(spark, tables.SourceRef.for_spec(task), task).columns == ["K"]
        assert tables.read_source(spark, lambda s: s.range(5).withColumnRenamed("id", "a"), task).count() == 5
        target = tables.target_columns_of(spark.table("ferry_test.beta"), "t").first()
        assert (target["column_name"], target["data_type"], target["nullable"]) == ("a", "bigint", True)
    finally:
        spark.sql("DROP DATABASE ferry_test CASCADE")


def test_path_source(spark, sf_dir):
    ref = tables.SourceRef("path", f"{sf_dir}/nation.parquet")
    assert tables.read_table(spark, ref).count() == 25
    with pytest.raises(ValueError):
        tables.read_table(spark, tables.SourceRef("ftp", "x"))


def test_dictionary_columns(spark):
    rows = [("APP", "T", 1, "ID", "NUMBER", 8, 0, 0, "N"), ("APP", "T", 2, "N", "NUMBER", None, None, 0, "Y"),
            ("APP", "T", 3, "TS", "TIMESTAMP(6)", None, 6, 0, "Y"), ("APP", "T", 4, "V", "VARCHAR2", None, None, 20, "Y"),
            ("APP", "T", 5, "TZ", "TIMESTAMP(6) WITH TIME ZONE", None, 6, 0, "Y")]
    d = spark.createDataFrame(rows, "owner string, table_name string, column_id int, column_name string, data_type string, data_precision int, data_scale int, char_length int, nullable string")
    got = {r["column_name"]: (r["type_name"], r["precision"], r["scale"], r["length"], r["fsp"]) for r in tables.dictionary_columns(d).collect()}
    assert got == {
        "ID": ("NUMBER", 8, 0, None, None), "N": ("NUMBER", None, None, None, None), "TS": ("TIMESTAMP", None, None, None, 6),
        "V": ("VARCHAR2", None, None, 20, None), "TZ": ("TIMESTAMP(6) WITH TIME ZONE", None, None, None, None),
    }
    assert [r["table_name"] for r in tables.dictionary_tables(d.select("owner", "table_name").distinct(), "APP").collect()] == ["T"]


def test_target_dictionary(spark):
    rows = [("db", "t", 1, "ID", "decimal(8,0)", "decimal", 8, 0, None, None, "NO", None, None, None), ("db", "t", 2, "V", "varchar(5)", "varchar", None, None, 5, None, "YES", "utf8mb4", "x", "")]
    d = spark.createDataFrame(rows, "table_schema string, table_name string, ordinal_position int, column_name string, column_type string, data_type string, numeric_precision int, numeric_scale int, character_maximum_length int, datetime_precision int, is_nullable string, character_set_name string, column_default string, extra string")
    got = tables.dictionary_target_columns(d).orderBy("ordinal").collect()
    assert (got[0]["nullable"], got[0]["extra"], got[1]["default_value"], got[1]["length"]) == (False, "", "x", 5)


def test_unique_keys(spark):
    rows = [("t", "PRIMARY", 2, "B", 0), ("t", "PRIMARY", 1, "A", 0), ("t", "idx", 1, "C", 1)]
    d = spark.createDataFrame(rows, "task string, key_name string, seq int, column_name string, non_unique int")
    assert [tuple(r) for r in tables.unique_keys(d).collect()] == [("t", "PRIMARY", ["A", "B"])]


def test_orphan_staging(spark):
    names = ["T__stg_20240102030405_00aaff", "T__stg_20240102030405_00AAFF", "T__stg_20240102030405_0000aa", "plain", "A__stg_B__stg_20240102030405_123456", "T__stg_99999999999999_000000"]
    got = tables.orphan_staging(spark.createDataFrame([(n,) for n in names], "table_name string"), spark.createDataFrame([("20240102030405_0000aa",)], "run_id string"))
    rows = {r["table_name"]: (r["target_table"], str(r["started_at"])) for r in got.collect()}
    assert rows == {
        names[0]: ("T", "2024-01-02 03:04:05"), names[4]: ("A__stg_B", "2024-01-02 03:04:05"), names[5]: ("T", "None"),
    }


@pytest.mark.parametrize("text, good", [("20240102030405_0a1b2c", True), ("20240102030405_0A1B2C", False), ("20240102030405_0a1b2", False), ("20240102030405_0a1b2c\n", False)])
def test_run_ids(spark, text, good):
    df = spark.createDataFrame([(text,)], "r string")
    assert df.select(runs.is_run_id(F.col("r"))).first()[0] is good


def test_jdbc_options():
    got = jdbc.read_options("(SELECT 1) q", {"url": "jdbc:x"}, ["N_BARE"], ("ID", "1", "100", 4))
    assert got == {
        "fetchsize": "100", "preferTimestampNTZ": "true", "url": "jdbc:x", "dbtable": "(SELECT 1) q", "customSchema": "`N_BARE` STRING",
        "partitionColumn": "ID", "lowerBound": "1", "upperBound": "100", "numPartitions": "4",
    }


def test_upsert_statement():
    assert jdbc.upsert_statement("s", "t`x", ["ID", "V"], ["id"]) == (
        "INSERT INTO `t``x` (`ID`, `V`) SELECT `ID`, `V` FROM `s` ON DUPLICATE KEY UPDATE `V` = VALUES(`V`)"
    )
    assert jdbc.upsert_statement("s", "t", ["A", "B"], ["A", "B"]).endswith("ON DUPLICATE KEY UPDATE `A` = `A`")


class FakeConnection:
    """Stands in for a java.sql.Connection."""

    def __init__(self, staged, affected):
        self.staged, self.affected, self.log = staged, affected, []

    def setAutoCommit(self, on):
        self.log.append(("autocommit", on))

    def createStatement(self):
        return self

    def executeQuery(self, text):
        return self

    def next(self):
        return True

    def getLong(self, i):
        return self.staged

    def executeUpdate(self, text):
        self.log.append("update")
        return self.affected

    def commit(self):
        self.log.append("commit")

    def rollback(self):
        self.log.append("rollback")


def test_jdbc_publish_commits_once():
    c = FakeConnection(3, 5)
    assert jdbc.publish_jdbc(c, "s", "t", ["ID", "V"], ["ID"], 3) == 5
    assert c.log == [("autocommit", False), "update", "commit"]


@pytest.mark.parametrize("staged, affected, log", [(2, 3, ["rollback"]), (3, 7, ["update", "rollback"]), (3, 2, ["update", "rollback"])])
def test_jdbc_publish_rolls_back(staged, affected, log):
    c = FakeConnection(staged, affected)
    with pytest.raises(jdbc.VerifyFailed):
        jdbc.publish_jdbc(c, "s", "t", ["ID", "V"], ["ID"], 3)
    assert c.log[1:] == log


def test_many_spec_audit_agrees_with_one(spark):
    """An empty key, column or condition list is reported, not skipped."""
    schema = ("spec_id int, owner string, table_name string, dblink string, target_table string, primary_key array<string>, "
              "columns array<struct<source:string,target:string>>, conditions array<struct<column:string,parameter:string,value_source:string,constant:string>>, order_by array<struct<column:string>>")
    df = spark.createDataFrame([(1, "A", "T", None, "X", [], [], [], []), (2, "A", "T", None, "X", ["K"], [("K", "K")], [], [])], schema)
    got = sorted((r["spec_id"], r["rule"]) for r in spec_audit.audit_specs(df).collect())
    assert got == [(1, "NO_COLUMN"), (1, "NO_KEY")]
    assert "Exchange" not in spec_audit.audit_specs(df)._jdf.queryExecution().executedPlan().toString()
