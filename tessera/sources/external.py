"""Parquet tables of others as relations of the engine: three types, declared keys, derived columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..types import BOOL, INT, TEXT, Column, Table

#: Spark types that become a column type; columns of other types are left out.
_KINDS = {"bigint": INT, "int": INT, "smallint": INT, "tinyint": INT, "string": TEXT, "boolean": BOOL}
#: The driver's tables and their keys; lineitem has none, so it can be read but not managed.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",),
    "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"), "labels": ("doc_id",),
    "embeddings": ("vec_id",), "lineitem": (),
}


@dataclass
class External:
    """A directory of Parquet tables. derived: table -> {column: (SQL expression, type)} added when it is read."""

    spark: SparkSession
    root: str
    derived: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)
    catalog: Catalog = field(default_factory=Catalog)

    def register(self, name: str, key: tuple[str, ...] | None = None) -> Table:
        """Declares the table from its file's schema."""
        known = self.catalog.by_name(name)
        if known:
            return known
        key = KEYS.get(name, ()) if key is None else key
        kinds = [(n, _KINDS[t]) for n, t in self.spark.read.parquet(f"{self.root}/{name}.parquet").dtypes if t in _KINDS]
        kinds += [(n, t) for n, (_, t) in self.derived.get(name, {}).items()]
        table = Table(self.catalog.next_id, name, tuple(Column(k, n, t, n not in key) for k, (n, t) in enumerate(kinds, 1)), key)
        if key:
            self.catalog.install(table)
        else:
            self.catalog.declare(table)
        return table

    def read(self, name: str) -> DataFrame:
        """The table's rows with integers as BIGINT: a projection that Catalyst prunes and pushes filters through."""
        table = self.register(name)
        rows = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        derived = {n: e for n, (e, _) in self.derived.get(name, {}).items()}
        out = []
        for c in table.columns:
            if c.name in derived:
                out.append(f"{derived[c.name]} AS `{c.name}`")
            elif c.type == INT and dict(rows.dtypes)[c.name] != "bigint":
                out.append(f"CAST(`{c.name}` AS BIGINT) AS `{c.name}`")
            else:
                out.append(f"`{c.name}`")
        return rows.selectExpr(*out)

    def sql(self, text: str) -> DataFrame:
        """A SELECT over the tables, as a lazy DataFrame."""
        from ..errors import UnsupportedSql
        from ..plans import ast, binder, compiler, parser

        statement = parser.parse(text)
        if not isinstance(statement, ast.Select):
            raise UnsupportedSql("external tables are read only")
        if (statement.table in KEYS or statement.table in self.derived) and self.catalog.by_name(statement.table) is None:
            self.register(statement.table)
        bound = binder.bind(statement, self.catalog)
        return compiler.select(self.read(bound.table.name), bound)
