"""Verified table copy on Spark: declare a task, audit it, stage it, check it, publish it."""

from tableferry.spec import (
    ColumnMapping,
    Condition,
    OrderTerm,
    SpecError,
    TaskSpec,
    apply_spec,
    check_run_params,
)

__all__ = [
    "ColumnMapping",
    "Condition",
    "OrderTerm",
    "SpecError",
    "TaskSpec",
    "apply_spec",
    "check_run_params",
]
