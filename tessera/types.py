"""The three column types and the shape of a table."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from .errors import ConstraintViolation, SchemaMismatch

INT, TEXT, BOOL, NULL = "INT", "TEXT", "BOOL", "NULL"  # NULL is the type of the literal, never of a column
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
SPARK = {INT: T.LongType(), TEXT: T.StringType(), BOOL: T.BooleanType()}
DDL = {INT: "bigint", TEXT: "string", BOOL: "boolean"}
#: Names that versions and intents add to a table's columns.
SYSTEM = ("__op", "__start_ts", "__commit_ts", "__txn_id")


@dataclass(frozen=True)
class Column:
    id: int
    name: str
    type: str
    nullable: bool


@dataclass(frozen=True)
class Table:
    """primary_key holds column names in key order."""

    id: int
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]
    version: int = 1

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def row_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK[c.type], c.nullable, {"column_id": c.id}) for c in self.columns])

    @property
    def log_schema(self) -> T.StructType:
        """Of versions: columns are nullable, since tombstones carry the key alone."""
        fields = [T.StructField(c.name, SPARK[c.type], True) for c in self.columns]
        return T.StructType([*fields, T.StructField("__op", T.StringType()), T.StructField("__start_ts", T.LongType()), T.StructField("__commit_ts", T.LongType()), T.StructField("__txn_id", T.LongType())])

    def validate(self) -> Table:
        if not self.columns:
            raise ConstraintViolation(f"table {self.name} must define at least one column")
        if len({c.name for c in self.columns}) < len(self.columns) or len({c.id for c in self.columns}) < len(self.columns):
            raise ConstraintViolation(f"table {self.name} repeats a column")
        if any(c.type not in SPARK or c.id < 1 or not c.name for c in self.columns):
            raise ConstraintViolation(f"table {self.name} has an invalid column")
        if not self.primary_key or len(set(self.primary_key)) < len(self.primary_key):
            raise ConstraintViolation(f"table {self.name} needs a primary key without repeats")
        for name in self.primary_key:
            c = self.column(name)
            if c is None:
                raise SchemaMismatch(f"primary key column does not exist: {name}")
            if c.nullable:
                raise ConstraintViolation(f"primary key column {name} cannot be nullable")
        return self

    def to_json(self) -> str:
        return json.dumps({"id": self.id, "name": self.name, "version": self.version, "primary_key": list(self.primary_key), "columns": [vars(c) for c in self.columns]})

    @classmethod
    def from_json(cls, text: str) -> Table:
        d = json.loads(text)
        return cls(d["id"], d["name"], tuple(Column(**c) for c in d["columns"]), tuple(d["primary_key"]), d["version"])

    def with_id(self, id: int) -> Table:
        return replace(self, id=id)
