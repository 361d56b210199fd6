"""A copy task: one source table, a column mapping, AND-ed conditions, an order and a key."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, fields
from datetime import date
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: an unquoted identifier of the source database.
IDENTIFIER_GRAMMAR = r"[A-Za-z][A-Za-z0-9_$#]*"

OPERATORS = ("gt", "lt", "eq")
VALUE_TYPES = ("text", "number", "date")
VALUE_SOURCES = ("constant", "runtime")
DIRECTIONS = ("asc", "desc")


class SpecError(ValueError):
    """A task or its run parameters cannot be used; `problems` lists every reason."""

    def __init__(self, problems: Iterable[str]):
        self.problems = list(problems)
        super().__init__("; ".join(self.problems))


@dataclass(frozen=True)
class ColumnMapping:
    source: str
    target: str


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value_type: str
    parameter: str
    value_source: str
    constant: str = ""


@dataclass(frozen=True)
class OrderTerm:
    column: str
    direction: str = "asc"


def _strict(cls, raw: Mapping):
    unknown = set(raw) - {f.name for f in fields(cls)}
    if unknown:
        raise SpecError([f"{cls.__name__}: unknown field {name}" for name in sorted(unknown)])
    try:
        return cls(**raw)
    except TypeError as error:
        raise SpecError([f"{cls.__name__}: {error}"]) from error


@dataclass(frozen=True)
class TaskSpec:
    owner: str
    table: str
    target_table: str
    primary_key: tuple[str, ...]
    columns: tuple[ColumnMapping, ...]
    conditions: tuple[Condition, ...] = field(default=())
    order_by: tuple[OrderTerm, ...] = field(default=())
    dblink: str | None = None

    @classmethod
    def from_dict(cls, raw: Mapping) -> "TaskSpec":
        """Build from a plain mapping (e.g. parsed JSON); unknown fields are errors."""
        parts = dict(raw)
        parts["columns"] = tuple(_strict(ColumnMapping, c) for c in raw.get("columns", ()))
        parts["conditions"] = tuple(_strict(Condition, c) for c in raw.get("conditions", ()))
        parts["order_by"] = tuple(_strict(OrderTerm, t) for t in raw.get("order_by", ()))
        parts["primary_key"] = tuple(raw.get("primary_key", ()))
        return _strict(cls, parts)

    def to_dict(self) -> dict:
        return asdict(self)

    def source_name(self) -> str:
        """`owner.table`, followed by `@link` when the table sits behind a link."""
        return f"{self.owner}.{self.table}" + (f"@{self.dblink}" if self.dblink else "")

    def runtime_parameters(self) -> list[Condition]:
        """Conditions whose value comes with each run, by parameter name."""
        asked = [c for c in self.conditions if c.value_source == "runtime"]
        return sorted(asked, key=lambda c: c.parameter)

    def bindings(self, params: Mapping[str, str]) -> dict[str, str]:
        """Value of every parameter; a runtime parameter without a value is an error."""
        missing = [c.parameter for c in self.runtime_parameters() if c.parameter not in params]
        if missing:
            raise SpecError([f"run parameter {name} has no value" for name in missing])
        return {
            c.parameter: c.constant if c.value_source == "constant" else params[c.parameter]
            for c in self.conditions
        }

    def problems(self) -> list[str]:
        """Every rule this spec breaks; `operators.spec_audit` is the same for many specs."""
        found = []
        names = [("owner", self.owner), ("table", self.table)]
        names += [("dblink", self.dblink)] if self.dblink is not None else []
        names += [("column", c.source) for c in self.columns]
        names += [("target column", c.target) for c in self.columns]
        names += [("primary key", k) for k in self.primary_key]
        names += [("condition column", c.column) for c in self.conditions]
        names += [("parameter", c.parameter) for c in self.conditions]
        names += [("order by column", t.column) for t in self.order_by]
        found += [
            f"{what} {name!r} is not an unquoted identifier"
            for what, name in names
            if not re.fullmatch(IDENTIFIER_GRAMMAR, name)
        ]
        if not self.target_table.strip():
            found.append("target table is blank")
        if not self.columns:
            found.append("no column selected")
        if not self.primary_key:
            found.append("no key column chosen")
        targets = {c.target.upper() for c in self.columns}
        found += _repeats("source column", [c.source.upper() for c in self.columns])
        found += _repeats("target column", [c.target.upper() for c in self.columns])
        found += _repeats("key column", [k.upper() for k in self.primary_key])
        found += [
            f"key column {k} is not among the target columns"
            for k in self.primary_key
            if k.upper() not in targets
        ]
        found += _repeats("parameter", [c.parameter.lower() for c in self.conditions])
        for c in self.conditions:
            if c.operator not in OPERATORS or c.value_type not in VALUE_TYPES:
                found.append(f"condition {c.parameter}: unknown operator or value type")
            if c.value_source not in VALUE_SOURCES:
                found.append(f"condition {c.parameter}: unknown value source")
            if c.value_source == "constant" and not c.constant:
                found.append(f"condition {c.parameter} has no constant value")
            if c.value_source == "runtime" and c.constant:
                found.append(f"condition {c.parameter} is set per run and must hold no constant")
        found += [
            f"order by {t.column}: unknown direction"
            for t in self.order_by
            if t.direction not in DIRECTIONS
        ]
        return found

    def validate(self) -> None:
        found = self.problems()
        if found:
            raise SpecError(found)


def _repeats(what: str, names: list[str]) -> list[str]:
    return [f"{what} {name} is repeated" for i, name in enumerate(names) if name in names[:i]]


def check_run_params(spec: TaskSpec, params: Mapping[str, str]) -> None:
    """The given run parameters must be exactly the ones the spec asks for."""
    asked = {c.parameter for c in spec.runtime_parameters()}
    found = [f"run parameter {name} has no value" for name in sorted(asked - set(params))]
    found += [f"run parameter {name} is not declared" for name in sorted(set(params) - asked)]
    if found:
        raise SpecError(found)


def typed_literal(value: str, value_type: str, empty_text_is_null: bool = True) -> Column:
    """A condition value as a literal of its declared type; a value that does not parse fails.

    The source database binds an empty text as NULL, so no row matches it.
    """
    if value_type == "text":
        return F.lit(None).cast("string") if value == "" and empty_text_is_null else F.lit(value)
    if value_type == "number":
        try:
            return F.lit(Decimal(value))
        except InvalidOperation as error:
            raise SpecError([f"{value!r} is not a number"]) from error
    try:
        day = date.fromisoformat(value)
    except ValueError as error:
        raise SpecError([f"{value!r} is not a date of the form YYYY-MM-DD"]) from error
    return F.lit(day).cast("timestamp_ntz")


def condition_column(condition: Condition, value: str, empty_text_is_null: bool = True) -> Column:
    literal = typed_literal(value, condition.value_type, empty_text_is_null)
    column = F.col(condition.column)
    return {"gt": column > literal, "lt": column < literal, "eq": column == literal}[
        condition.operator
    ]


def order_columns(terms: Iterable[OrderTerm]) -> list[Column]:
    """ORDER BY terms with the source database's null order: last ascending, first descending."""
    return [
        F.col(t.column).desc_nulls_first()
        if t.direction == "desc"
        else F.col(t.column).asc_nulls_last()
        for t in terms
    ]


def apply_spec(
    df: DataFrame,
    spec: TaskSpec,
    params: Mapping[str, str] | None = None,
    ordered: bool = False,
    empty_text_is_null: bool = True,
) -> DataFrame:
    """The rows and columns a task copies, as one declarative plan over the source.

    Conditions and order name source columns, so both come before the projection. The global
    sort is off by default: an upsert does not depend on row order, and batch numbering sorts
    by itself.
    """
    spec.validate()
    check_run_params(spec, params or {})
    values = spec.bindings(params or {})
    if spec.conditions:
        tests = [
            condition_column(c, values[c.parameter], empty_text_is_null) for c in spec.conditions
        ]
        df = df.filter(reduce(lambda left, right: left & right, tests))
    if ordered and spec.order_by:
        df = df.orderBy(*order_columns(spec.order_by))
    return df.select(*[F.col(c.source).alias(c.target) for c in spec.columns])
