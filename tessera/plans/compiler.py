"""From typed statements to DataFrames.

Filters stay plain Column trees, so Catalyst pushes them to the Parquet scan, prunes columns and generates code. Two
shapes differ from what SQL users would write: a predicate that can raise is evaluated for candidate rows only and
strictly on both sides, and a contradiction over the key reads nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..types import DDL, Table
from .binder import BoundSelect, Expr


@dataclass(frozen=True)
class Access:
    """kind: 'scan', 'point' (key holds a value for each key column) or 'empty'."""

    kind: str
    key: tuple[tuple[str, Any], ...] = ()


def column(e: Expr) -> Column:
    if e.op == "column":
        return F.col(f"`{e.value.replace('`', '``')}`")
    if e.op == "literal":
        return F.lit(e.value).cast(DDL.get(e.type, "string"))
    args = [column(a) for a in e.args]
    if e.op in ("is null", "is not null"):
        return args[0].isNull() if e.op == "is null" else args[0].isNotNull()
    if e.op == "not":
        return ~args[0]
    if e.op == "neg":
        return -args[0]
    if e.op == "pos":
        return args[0]
    a, b = args
    if e.op in ("AND", "OR"):
        if e.can_raise:
            return scalar.strict_and(a, b) if e.op == "AND" else scalar.strict_or(a, b)
        return a & b if e.op == "AND" else a | b
    of = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: scalar.divide(a, b), "%": lambda: scalar.remainder(a, b), "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}
    return of[e.op]()


def conjuncts(e: Expr) -> list[Expr]:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if e.op == "AND" else [e]


def access(table: Table, where: Expr | None) -> Access:
    """What the predicate's top-level equalities of key columns and literals say about the rows to read."""
    found: dict[str, Any] = {}
    for e in conjuncts(where) if where else []:
        if e.op == "=" and {a.op for a in e.args} == {"column", "literal"}:
            name, value = sorted(e.args, key=lambda a: a.op)
            if name.value in table.primary_key and found.setdefault(name.value, value.value) != value.value:
                return Access("empty")
    if set(found) == set(table.primary_key):
        return Access("point", tuple((k, found[k]) for k in table.primary_key))
    return Access("scan")


def restrict(rows: DataFrame, table: Table, where: Expr | None) -> DataFrame:
    """The rows for which the predicate is true. Errors surface for rows that the access path would read."""
    path = access(table, where)
    if path.kind == "empty":
        return rows.limit(0)
    if where is None:
        return rows
    if not where.can_raise:
        return rows.where(column(where))
    key = [F.col(f"`{k}`") == F.lit(v) for k, v in path.key]
    if key:
        return rows.where(scalar.all_of(key)).where(scalar.only_for(scalar.all_of(key), column(where)))
    return rows.where(scalar.only_for(F.col(f"`{table.primary_key[0]}`").isNotNull() if table.primary_key else F.lit(True), column(where)))


def select(rows: DataFrame, s: BoundSelect) -> DataFrame:
    """Columns by position, in the order asked for; a column asked for twice comes twice."""
    return restrict(rows, s.table, s.where).select(*(F.col(f"`{c.name}`") for c in s.columns))


def ordered(rows: DataFrame, table: Table) -> DataFrame:
    """Rows in key order, for the boundary where they leave the engine."""
    return rows.orderBy(*(F.col(f"`{k}`") for k in table.primary_key))
