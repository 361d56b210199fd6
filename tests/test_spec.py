"""Task specs: validation, typed conditions, parameters, projection, order."""

import pytest

from tableferry import ColumnMapping, Condition, OrderTerm, SpecError, TaskSpec, apply_spec, check_run_params
from tableferry.spec import typed_literal


def spec(**changes):
    parts = dict(
        owner="APP", table="T_SRC", target_table="T_TGT", primary_key=("ID",),
        columns=(ColumnMapping("ID", "ID"), ColumnMapping("GRP", "GROUP_NAME")),
    )
    return TaskSpec(**{**parts, **changes})


@pytest.fixture()
def rows(spark):
    data = [(1, "A", "2026-08-14 00:00:00"), (2, "A", "2026-08-14 10:00:00"), (3, "B", "2026-08-15 00:00:00"), (4, None, None), (5, "", None)]
    return spark.createDataFrame(data, "ID int, GRP string, D string").selectExpr("ID", "GRP", "CAST(D AS timestamp_ntz) AS D")


def ids(df):
    return sorted(r["ID"] for r in df.collect())


def test_whole_table_without_conditions(rows):
    assert ids(apply_spec(rows, spec())) == [1, 2, 3, 4, 5]
    assert apply_spec(rows, spec()).columns == ["ID", "GROUP_NAME"]


def test_constant_and_runtime_conditions(rows):
    task = spec(conditions=(
        Condition("GRP", "eq", "text", "P_GRP", "constant", "A"),
        Condition("ID", "gt", "number", "P_ID", "runtime"),
    ))
    assert ids(apply_spec(rows, task, {"P_ID": "1"})) == [2]


def test_date_condition_is_midnight(rows):
    day = Condition("D", "eq", "date", "P_DAY", "runtime")
    assert ids(apply_spec(rows, spec(conditions=(day,)), {"P_DAY": "2026-08-14"})) == [1]


def test_null_never_matches(rows):
    low = Condition("GRP", "lt", "text", "P", "constant", "Z")
    assert ids(apply_spec(rows, spec(conditions=(low,)))) == [1, 2, 3, 5]


def test_empty_text_parameter_matches_nothing(rows):
    task = spec(conditions=(Condition("GRP", "gt", "text", "P", "runtime"),))
    assert ids(apply_spec(rows, task, {"P": ""})) == []
    assert ids(apply_spec(rows, task, {"P": ""}, empty_text_is_null=False)) == [1, 2, 3]


def test_null_order_of_the_source(rows):
    up = apply_spec(rows, spec(order_by=(OrderTerm("GRP"), OrderTerm("ID"))), ordered=True)
    assert [r["ID"] for r in up.collect()] == [5, 1, 2, 3, 4]
    down = apply_spec(rows, spec(order_by=(OrderTerm("GRP", "desc"), OrderTerm("ID"))), ordered=True)
    assert [r["ID"] for r in down.collect()] == [4, 3, 1, 2, 5]


def test_bad_values_fail():
    for value, kind in (("abc", "number"), ("2026-02-30", "date"), ("14.08.2026", "date")):
        with pytest.raises(SpecError):
            typed_literal(value, kind)


def test_run_parameters_must_match():
    task = spec(conditions=(Condition("ID", "gt", "number", "P_ID", "runtime"), Condition("GRP", "eq", "text", "A_GRP", "runtime")))
    assert [c.parameter for c in task.runtime_parameters()] == ["A_GRP", "P_ID"]
    with pytest.raises(SpecError) as error:
        check_run_params(task, {"P_ID": "1", "OTHER": "x"})
    assert error.value.problems == ["run parameter A_GRP has no value", "run parameter OTHER is not declared"]


@pytest.mark.parametrize(
    "changes, word",
    [
        ({"owner": "1APP"}, "owner"), ({"table": "T;DROP"}, "table"), ({"dblink": "a b"}, "dblink"),
        ({"target_table": "  "}, "blank"), ({"columns": ()}, "no column"), ({"primary_key": ()}, "no key"),
        ({"primary_key": ("ID", "id")}, "repeated"), ({"primary_key": ("GRP",)}, "not among"),
        ({"columns": (ColumnMapping("ID", "ID"), ColumnMapping("id", "X"))}, "source column ID is repeated"),
        ({"columns": (ColumnMapping("ID", "ID"), ColumnMapping("X", "id"))}, "target column ID is repeated"),
        ({"conditions": (Condition("ID", "gt", "number", "P", "constant"),)}, "no constant"),
        ({"conditions": (Condition("ID", "gt", "number", "P", "runtime", "1"),)}, "must hold no constant"),
        ({"conditions": (Condition("ID", "gt", "number", "P", "runtime"), Condition("ID", "lt", "number", "p", "runtime"))}, "parameter p is repeated"),
        ({"order_by": (OrderTerm("ID DESC"),)}, "order by"),
        ({"owner": "APP\n"}, "owner"),
    ],
)
def test_broken_specs(changes, word):
    assert any(word in p for p in spec(**changes).problems()), spec(**changes).problems()


def test_round_trip_and_unknown_fields():
    task = spec(conditions=(Condition("ID", "gt", "number", "P", "runtime"),), order_by=(OrderTerm("ID", "desc"),), dblink="FA")
    assert TaskSpec.from_dict(task.to_dict()) == task
    assert task.source_name() == "APP.T_SRC@FA"
    with pytest.raises(SpecError):
        TaskSpec.from_dict({**task.to_dict(), "source_sql": "SELECT 1"})


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    task = TaskSpec("S", "ORDERS", "T", ("K",), (ColumnMapping("o_orderkey", "K"),),
                    (Condition("o_orderstatus", "eq", "text", "P", "constant", "F"),))
    plan = apply_spec(orders, task)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    assert "Exchange" not in plan
