"""CREATE TABLE texts read back."""

from tableferry.operators import ddl, ddl_reader, mapping_audit

ODD = """-- a remark, with `quotes`
create table if not exists `odd``table` (`a,b` decimal(12, 4) not null default '1,5 not null',
  `c(``)` VARCHAR(20) CHARACTER SET latin1 NULL DEFAULT 'it''s', `n` NUMERIC(9), `m` DECIMAL, `p` DECIMAL(<p>,<s>) NULL,
  `id` bigint AUTO_INCREMENT UNIQUE COMMENT 'PRIMARY KEY', `t` DATETIME, `u` DATETIME(6) DEFAULT NULL, `e` enum('x','y(,)') NOT NULL,
  UNIQUE KEY `uq` (`a,b`, `n`(10)), CONSTRAINT `k` UNIQUE (`t`), CHECK ((`n` > 0) or (`m` in (1, 2))), PRIMARY KEY (`m`)
) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;"""


def test_quoting_types_defaults_and_keys(spark):
    texts = spark.createDataFrame([("x", ODD)], "task string, ddl string")
    rows = {r.column_name: r for r in ddl_reader.read_columns(texts).collect()}
    assert list(sorted(rows, key=lambda n: rows[n].ordinal)) == ["a,b", "c(`)", "n", "m", "p", "id", "t", "u", "e"]
    a = rows["a,b"]
    assert (a.data_type, a.precision, a.scale, a.nullable, a.default_value) == ("decimal", 12, 4, False, "1,5 not null")
    c = rows["c(`)"]
    assert (c.column_type, c.length, c.character_set, c.default_value, c.nullable) == ("varchar(20)", 20, "latin1", "it's", True)
    assert [(rows[k].precision, rows[k].scale) for k in ("n", "m", "p")] == [(9, 0), (10, 0), (None, None)]
    assert (rows["id"].extra, rows["id"].nullable, rows["m"].nullable) == ("AUTO_INCREMENT", True, False)
    assert (rows["t"].datetime_precision, rows["u"].datetime_precision, rows["u"].default_value) == (0, 6, None)
    assert rows["e"].nullable is False and rows["e"].column_type == "enum('x','y(,)')"
    keys = {(r.key_name, tuple(r.key_columns)) for r in ddl_reader.read_keys(texts).collect()}
    assert keys == {("uq", ("a,b", "n")), ("t", ("t",)), ("id", ("id",)), ("PRIMARY", ("m",))}
    assert [r.item[:5] for r in ddl_reader.unread(texts).collect()] == ["CHECK"]
    assert {r.target_table for r in ddl_reader.read_items(texts).collect()} == {"odd`table"}


def test_texts_that_are_no_table(spark):
    texts = spark.createDataFrame([("a", "DROP TABLE `x`"), ("b", None), ("c", ""), ("d", "CREATE TABLE `x` ()")], "task string, ddl string")
    assert ddl_reader.read_columns(texts).count() == 0 and ddl_reader.read_keys(texts).count() == 0
    assert {r.task for r in ddl_reader.unread(texts).collect()} == {"a", "b", "c"}


def test_own_ddl_reads_back_without_issues_and_drift_is_found(spark):
    source = spark.createDataFrame(
        [("x", 1, "ID", "NUMBER", 12, 0, None, None), ("x", 2, "NA`ME", "VARCHAR2", None, None, 40, None),
         ("x", 3, "AT", "TIMESTAMP", None, None, None, 6), ("x", 4, "DAY", "DATE", None, None, None, None)],
        "task string, ordinal long, column_name string, type_name string, precision long, scale long, length long, fsp long",
    )
    tasks = spark.createDataFrame([("x", "T", ["ID"])], "task string, target_table string, key_columns array<string>")
    made = ddl.target_ddl(tasks, source).select("task", "ddl")

    def rules(texts):
        found = mapping_audit.mapping_issues(tasks, source, ddl_reader.read_columns(texts), ddl_reader.read_keys(texts))
        return sorted((r.column_name, r.rule) for r in found.collect())

    assert rules(made) == [] and ddl_reader.unread(made).count() == 0
    drift = made.selectExpr("task", "replace(replace(replace(ddl, 'DECIMAL(12,0)', 'DECIMAL(9,0)'), 'DATETIME(6)', 'DATETIME'), 'PRIMARY KEY (`ID`)', 'UNIQUE (`AT`)') AS ddl")
    assert rules(drift) == [("<primary_key>", "KEY_NOT_UNIQUE"), ("AT", "TIME_FRACTION"), ("ID", "INTEGER_SHORT")]
