"""SQL sessions over a store: autocommit, explicit transactions, read-your-writes.

Statements bind against the catalog and compile to DataFrames; nothing is collected but counts and, at the end, the
result's rows if the caller asks for them. A transaction's writes are one DataFrame a table with a row a key, written
to the shared folder after each statement, so that plans stay short.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConstraintViolation, InvalidArgument, UnsupportedSql, from_spark
from .operators import dml, versions
from .plans import ast, binder, compiler, parser
from .sources.store import Store
from .types import Table

#: The most rows that a statement may return or match over SQL; DataFrame callers can lift it.
MOST_ROWS = 100_000


@dataclass
class Result:
    """kind: created_table, mutation, query, transaction_started, transaction_committed, transaction_rolled_back."""

    kind: str
    details: dict[str, Any] = field(default_factory=dict)
    frame: DataFrame | None = None
    columns: list[tuple[str, str, bool]] = field(default_factory=list)  # name, type, nullable
    found: list[tuple] | None = None  # rows, where the row limit made the session read them

    def rows(self) -> list[tuple]:
        if self.found is not None or self.frame is None:
            return self.found or []
        try:
            return [tuple(r) for r in self.frame.collect()]
        except PySparkException as e:
            raise from_spark(e) from e

    def to_json(self) -> dict:
        rows = [list(r) for r in self.rows()]
        written = self.details.get("affected_rows", self.details.get("committed_writes", 0))
        out = {"ok": True, "columns": [c[0] for c in self.columns], "rows": rows, "stats": {"rows_read": len(rows), "rows_written": written}}
        return out if self.kind == "query" else out | {"result": {"type": self.kind, **self.details}}


@dataclass
class Transaction:
    id: int
    start_ts: int
    began: int  # commits that it reads
    pending: dict[int, DataFrame] = field(default_factory=dict)
    writes: dict[int, int] = field(default_factory=dict)


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A Spark session with the settings that the engine's semantics need: ANSI arithmetic, exact names, UTC, and no
    constant propagation, which would fold an expression that raises before it is known that a row needs it."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.ConstantPropagation", **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one in a local session without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


class Session:
    """One client's session. Leaving the context rolls an open transaction back."""

    def __init__(self, store: Store, most_rows: int | None = MOST_ROWS):
        self.store, self.most_rows, self.open = store, most_rows, None
        self.spark = store.spark

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: Any) -> None:
        self.open = None

    def sql(self, text: str) -> Result:
        """Runs one statement. Inside a transaction a statement that fails contributes nothing and leaves it open."""
        statement = parser.parse(text)
        self.store.check()
        bound = binder.bind(statement, self.store.catalog)
        try:
            return self._run(bound)
        except PySparkException as e:
            raise from_spark(e) from e

    def _run(self, s: Any) -> Result:
        if isinstance(s, ast.Begin):
            if self.open:
                raise InvalidArgument("a transaction is already open")
            self.open = Transaction(*self.store.begin())
            return Result("transaction_started", {"transaction_id": self.open.id, "start_timestamp": self.open.start_ts})
        if isinstance(s, ast.Commit | ast.Rollback):
            if self.open is None:
                raise InvalidArgument("no transaction is open")
            txn, self.open = self.open, None
            if isinstance(s, ast.Commit):
                return self._commit(txn)
            return Result("transaction_rolled_back", {"transaction_id": txn.id, "discarded_writes": sum(txn.writes.values())})
        if isinstance(s, ast.ShowTables):
            rows = [(t.name,) for t in self.store.catalog.tables()]
            return Result("query", {}, self.spark.createDataFrame(rows, "table_name string").coalesce(1), [("table_name", "TEXT", False)])
        if isinstance(s, binder.BoundCreate):
            if self.open:
                raise UnsupportedSql("CREATE TABLE inside a transaction")
            return Result("created_table", {"table_id": self.store.create_table(s.table).id})
        if self.open:
            return self._data(s, self.open)
        txn = Transaction(*self.store.begin())
        out = self._data(s, txn)
        self._commit(txn)
        return out

    def _commit(self, txn: Transaction) -> Result:
        wrote = [k for k, n in txn.writes.items() if n]
        if len(wrote) > 1:
            raise UnsupportedSql("a transaction that writes more than one table")
        if not wrote:
            return Result("transaction_committed", {"transaction_id": txn.id, "commit_timestamp": None, "committed_writes": 0})
        table = self.store.catalog.by_id(wrote[0])
        commit_ts, rows = self.store.commit(table, txn.pending[table.id], txn.start_ts, txn.id, txn.began)
        return Result("transaction_committed", {"transaction_id": txn.id, "commit_timestamp": commit_ts, "committed_writes": rows})

    # data statements

    def visible(self, table: Table, txn: Transaction) -> DataFrame:
        """The table as the transaction sees it."""
        rows = self.store.snapshot(table, until=txn.began)
        pending = txn.pending.get(table.id)
        return rows if pending is None else versions.overlay(rows, pending, list(table.primary_key))

    def _data(self, s: Any, txn: Transaction) -> Result:
        return {binder.BoundSelect: self._select, binder.BoundInsert: self._insert, binder.BoundUpdate: self._update, binder.BoundDelete: self._delete}[type(s)](s, txn)

    def _bounded(self, rows: DataFrame) -> None:
        if self.most_rows is not None and rows.limit(self.most_rows + 1).count() > self.most_rows:
            raise InvalidArgument(f"a statement may return or match {self.most_rows} rows at most")

    def _select(self, s: binder.BoundSelect, txn: Transaction) -> Result:
        rows = compiler.restrict(compiler.ordered(self.visible(s.table, txn), s.table), s.table, s.where)
        frame = rows.select(*(F.col(f"`{c.name}`") for c in s.columns))
        columns = [(c.name, c.type, c.nullable) for c in s.columns]
        if self.most_rows is None:
            return Result("query", {}, frame, columns)
        found = [tuple(r) for r in frame.limit(self.most_rows + 1).collect()]
        if len(found) > self.most_rows:
            raise InvalidArgument(f"a statement may return or match {self.most_rows} rows at most")
        return Result("query", {}, frame, columns, found)

    def _buffer(self, table: Table, new: DataFrame, txn: Transaction, operation: str) -> Result:
        """Makes a statement's stored writes part of the transaction: all or nothing."""
        n = new.count()
        before = txn.pending.get(table.id)
        if n:
            merged = new if before is None else self._stored(versions.merge_pending(before, new, list(table.primary_key)))
            txn.pending[table.id], txn.writes[table.id] = merged, merged.count()
        return Result("mutation", {"operation": operation, "affected_rows": n})

    def _stored(self, rows: DataFrame) -> DataFrame:
        shared_folder(self.spark)
        return rows.checkpoint()

    def _insert(self, s: binder.BoundInsert, txn: Transaction) -> Result:
        at = {c.name: k for k, c in enumerate(s.columns)}
        rows = [tuple(r[at[c.name]] if c.name in at else None for c in s.table.columns) for r in s.rows]
        frame = self.spark.createDataFrame(rows, s.table.row_schema)
        return self.insert(s.table, frame, txn)

    def insert(self, table: Table, rows: DataFrame, txn: Transaction | None = None) -> Result:
        """Inserts a DataFrame with the table's columns."""
        own = txn or self.open or Transaction(*self.store.begin())
        new = self._stored(dml.inserted(rows, table))
        if not versions.invalid_rows(new, table).isEmpty():
            raise ConstraintViolation("a value for a column that is not nullable is NULL")
        if not versions.duplicate_keys(new, list(table.primary_key)).isEmpty():
            raise ConstraintViolation("the statement inserts a key twice")
        if not dml.existing_keys(new, self.visible(table, own), table).isEmpty():
            raise ConstraintViolation("a row with the same primary key exists")
        out = self._buffer(table, new, own, "insert")
        if txn is None and self.open is None:
            self._commit(own)
        return out

    def _update(self, s: binder.BoundUpdate, txn: Transaction) -> Result:
        new = self._stored(dml.updated(self.visible(s.table, txn), s))
        self._bounded(new)
        return self._buffer(s.table, new, txn, "update")

    def _delete(self, s: binder.BoundDelete, txn: Transaction) -> Result:
        new = self._stored(dml.deleted(self.visible(s.table, txn), s))
        self._bounded(new)
        return self._buffer(s.table, new, txn, "delete")
