"""What the parser hands to the binder. Constructs outside the language never get here."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Number:
    """text as written; sign is folded in from an operator directly before it."""

    text: str


@dataclass(frozen=True)
class Literal:
    """A string, a boolean or None."""

    value: Any


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    operand: Any
    negated: bool


@dataclass
class ColumnDef:
    name: str
    type: str
    nulls: list[bool] = field(default_factory=list)
    primary: bool = False


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]
    keys: list[list[str]]


@dataclass
class Insert:
    table: str
    columns: list[str]
    rows: list[list[Any]]


@dataclass
class Select:
    table: str
    items: list[str | None]  # None is the wildcard
    where: Any | None


@dataclass
class Update:
    table: str
    assignments: list[tuple[str, Any]]
    where: Any


@dataclass
class Delete:
    table: str
    where: Any


@dataclass
class Begin:
    pass


@dataclass
class Commit:
    pass


@dataclass
class Rollback:
    pass


@dataclass
class ShowTables:
    pass
