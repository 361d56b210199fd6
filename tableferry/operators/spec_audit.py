"""Audit of many task specs at once: one row per broken rule, in one narrow pass.

A spec is one row: ``spec_id, owner, table_name, dblink, target_table, primary_key
ARRAY<STRING>, columns ARRAY<STRUCT<source, target>>, conditions ARRAY<STRUCT<column,
parameter, value_source, constant>>, order_by ARRAY<STRUCT<column>>``. All rules look at one
row only, so the job neither shuffles nor groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.spec import IDENTIFIER_GRAMMAR


def _is_identifier(name: Column) -> Column:
    return name.rlike("^" + IDENTIFIER_GRAMMAR + r"\z")


def _found(rule: str, subjects: Column) -> Column:
    """ARRAY<STRUCT<rule, subject>> from an array of offending names."""
    return F.transform(
        F.coalesce(subjects, F.array().cast("array<string>")),
        lambda s: F.struct(F.lit(rule).alias("rule"), s.alias("subject")),
    )


def _found_if(rule: str, broken: Column, subject: Column) -> Column:
    return _found(rule, F.when(broken, F.array(subject.cast("string"))))


def _bad_names(names: Column) -> Column:
    return F.filter(names, lambda n: ~F.coalesce(_is_identifier(n), F.lit(False)))


def _repeated(names: Column, fold) -> Column:
    """Second and later occurrences, compared without regard to case."""
    folded = F.transform(names, fold)
    return F.filter(
        F.transform(names, lambda n, i: F.when(F.array_position(folded, fold(n)) <= i, n)),
        lambda n: n.isNotNull(),
    )


def audit_specs(specs: DataFrame) -> DataFrame:
    """Rows ``spec_id, rule, subject``; a spec without rows is valid."""
    sources = F.transform("columns", lambda c: c["source"])
    targets = F.transform("columns", lambda c: c["target"])
    upper_targets = F.transform(targets, F.upper)
    parameters = F.transform("conditions", lambda c: c["parameter"])
    no_constant = F.filter(
        "conditions", lambda c: (c["value_source"] == "constant") & (c["constant"] == "")
    )
    stray_constant = F.filter(
        "conditions", lambda c: (c["value_source"] == "runtime") & (c["constant"] != "")
    )
    rules = [
        _found_if("OWNER_NOT_IDENTIFIER", ~_is_identifier(F.col("owner")), F.col("owner")),
        _found_if("TABLE_NOT_IDENTIFIER", ~_is_identifier(F.col("table_name")), F.col("table_name")),
        _found_if("LINK_NOT_IDENTIFIER", ~_is_identifier(F.col("dblink")), F.col("dblink")),
        _found_if("TARGET_TABLE_BLANK", F.trim("target_table") == "", F.col("target_table")),
        _found_if("NO_COLUMN", F.size("columns") == 0, F.lit("")),
        _found("COLUMN_NOT_IDENTIFIER", _bad_names(sources)),
        _found("TARGET_NOT_IDENTIFIER", _bad_names(targets)),
        _found("COLUMN_REPEATED", _repeated(sources, F.upper)),
        _found("TARGET_REPEATED", _repeated(targets, F.upper)),
        _found_if("NO_KEY", F.size("primary_key") == 0, F.lit("")),
        _found("KEY_NOT_IDENTIFIER", _bad_names(F.col("primary_key"))),
        _found("KEY_REPEATED", _repeated(F.col("primary_key"), F.upper)),
        _found(
            "KEY_NOT_SELECTED",
            F.filter("primary_key", lambda k: ~F.array_contains(upper_targets, F.upper(k))),
        ),
        _found(
            "CONDITION_NOT_IDENTIFIER",
            _bad_names(F.transform("conditions", lambda c: c["column"])),
        ),
        _found("PARAMETER_NOT_IDENTIFIER", _bad_names(parameters)),
        _found("PARAMETER_REPEATED", _repeated(parameters, F.lower)),
        _found("CONSTANT_MISSING", F.transform(no_constant, lambda c: c["parameter"])),
        _found("CONSTANT_NOT_ALLOWED", F.transform(stray_constant, lambda c: c["parameter"])),
        _found(
            "ORDER_NOT_IDENTIFIER", _bad_names(F.transform("order_by", lambda t: t["column"]))
        ),
    ]
    return specs.select("spec_id", F.explode(F.concat(*rules)).alias("issue")).select(
        "spec_id", "issue.rule", "issue.subject"
    )


def audit_run_params(runs: DataFrame) -> DataFrame:
    """Missing and undeclared run parameters of many runs.

    Input ``run_id, declared ARRAY<STRING>, params MAP<STRING,STRING>``; output one row
    ``run_id, rule, parameter`` per difference.
    """
    given = F.map_keys("params")
    missing = F.transform(
        F.array_except("declared", given),
        lambda p: F.struct(F.lit("PARAMETER_MISSING").alias("rule"), p.alias("parameter")),
    )
    undeclared = F.transform(
        F.array_except(given, "declared"),
        lambda p: F.struct(F.lit("PARAMETER_NOT_DECLARED").alias("rule"), p.alias("parameter")),
    )
    return runs.select("run_id", F.explode(F.concat(missing, undeclared)).alias("issue")).select(
        "run_id", "issue.rule", "issue.parameter"
    )
