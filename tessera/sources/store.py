"""A durable store of versions: append-only Parquet, published by commit markers.

    catalog/{n}.json            table definitions, one a file, never changed
    t{table}/log/{token}/       Parquet: a commit's versions
    commits/{n}.json            the marker of the n-th commit; it names the log folder, the transaction and its rows
    t{table}/ckpt/{ts}/         Parquet: the rows visible after the first n commits
    ckpts/{ts}.json             the checkpoint's marker: n, tables with row counts and checksums, allocator floors

Data is written first and its marker last, so a commit is there exactly when its marker is; folders without a marker
are leftovers of commits that did not happen. Markers are numbered without gaps and created exclusively, so a commit has
seen every one before it, whichever process wrote it, and timestamps rise with the numbers. A transaction reads the
commits up to the number that it began at: the newest checkpoint within them and the logs after it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..errors import CatalogOutcomeUnknown, CommitNotStaged, CommitOutcomeUnknown, CorruptData, InvalidArgument, RecoveryRequired, WriteConflict
from ..operators import recovery, versions
from ..types import Table
from .files import Files


@dataclass(frozen=True)
class Marker:
    n: int
    commit_ts: int
    start_ts: int
    txn_id: int
    table_id: int
    schema_version: int
    rows: int
    folder: str

    def to_json(self) -> str:
        return json.dumps(vars(self))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.catalog = Catalog()
        self.poisoned: Exception | None = None
        self.last_ts = self.last_txn = 0
        self._markers: list[Marker] = []
        self.recover()

    # recovery

    def recover(self) -> None:
        """Catalog, markers and allocator floors from the files; refuses what no sequence of commits leaves behind."""
        for name in self.files.names("catalog"):
            if name.endswith(".json"):
                self.catalog.install(Table.from_json(self.files.read(f"catalog/{name}")))
        self.refresh()
        seen: dict[int, int] = {}
        for m in self._markers:
            table = self.catalog.by_id(m.table_id)
            if table is None or table.version != m.schema_version:
                raise CorruptData(f"commit {m.commit_ts} is of an unknown table or schema version")
            if not m.commit_ts > m.start_ts > 0:
                raise CorruptData(f"commit {m.commit_ts} breaks the timestamp order")
            if seen.setdefault(m.txn_id, m.commit_ts) != m.commit_ts:
                raise CorruptData(f"transaction {m.txn_id} committed twice")
        for c in self.checkpoints():
            self.last_ts, self.last_txn = max(self.last_ts, c["max_ts"]), max(self.last_txn, c["max_txn_id"])
            self.catalog.raise_floor(c["next_table_id"])
        self.poisoned = None

    def refresh(self) -> None:
        """Markers that appeared since the last look."""
        while self.files.exists(name := f"commits/{len(self._markers) + 1:020d}.json"):
            m = Marker(**json.loads(self.files.read(name)))
            if m.n != len(self._markers) + 1 or (self._markers and m.commit_ts <= self._markers[-1].commit_ts):
                raise CorruptData(f"marker {name} is out of order")
            self._markers.append(m)
            self.last_ts, self.last_txn = max(self.last_ts, m.commit_ts, m.start_ts), max(self.last_txn, m.txn_id)

    # catalog

    def create_table(self, table: Table) -> Table:
        """Durable before it is visible."""
        self.check()
        ready = self.catalog.prepare(table)
        try:
            made = self.files.create(f"catalog/{ready.id:020d}.json", ready.to_json())
        except Exception as e:
            self.poisoned = e
            raise CatalogOutcomeUnknown("the table's definition may or may not be durable; reopen the store") from e
        if not made:
            raise CatalogOutcomeUnknown("another writer created a table; reopen the store")
        self.catalog.publish(ready)
        return ready

    # reads

    def log(self, table: Table, after: int = 0, until: int | None = None, read_ts: int | None = None) -> DataFrame:
        """Versions of the commits numbered after `after` and up to `until`, and up to the timestamp read_ts."""
        found = self._markers[after:until]
        folders = [f"{self.root}/{m.folder}" for m in found if m.table_id == table.id and (read_ts is None or m.commit_ts <= read_ts)]
        if not folders:
            return self.spark.createDataFrame([], table.log_schema)
        return self.spark.read.schema(table.log_schema).parquet(*folders)

    def markers(self) -> list[Marker]:
        return list(self._markers)

    def checkpoints(self) -> list[dict]:
        out = [json.loads(self.files.read(f"ckpts/{n}")) for n in self.files.names("ckpts") if n.endswith(".json")]
        return sorted(out, key=lambda c: c["ts"])

    def snapshot(self, table: Table, read_ts: int | None = None, until: int | None = None) -> DataFrame:
        """The table's rows after the first `until` commits (all known, without it), as of read_ts."""
        until = len(self._markers) if until is None else until
        fits = lambda c: c["n"] <= until and (read_ts is None or c["ts"] <= read_ts) and str(table.id) in c["tables"]
        base = next((c for c in reversed(self.checkpoints()) if fits(c)), None)
        key = list(table.primary_key)
        log = self.log(table, base["n"] if base else 0, until, read_ts)
        names = [f"`{n}`" for n in table.names]
        if base is None:
            return versions.snapshot(log, key).select(*names)
        rows = self.spark.read.schema(table.log_schema).parquet(f"{self.root}/t{table.id}/ckpt/{base['ts']:020d}").select(*names)
        newer = any(m.table_id == table.id for m in self._markers[base["n"] : until])
        return recovery.replay(rows, 0, log, key).select(*names) if newer else rows

    # commits

    def check(self) -> None:
        if self.poisoned is not None:
            raise RecoveryRequired("an earlier failure left an unknown outcome; reopen the store") from self.poisoned

    def begin(self) -> tuple[int, int, int]:
        """(transaction id, start timestamp, commits to read): the first two are new here."""
        self.check()
        self.refresh()
        self.last_txn, self.last_ts = self.last_txn + 1, self.last_ts + 1
        return self.last_txn, self.last_ts, len(self._markers)

    def commit(self, table: Table, pending: DataFrame, start_ts: int, txn_id: int, began: int) -> tuple[int, int]:
        """(commit timestamp, writes) of a transaction that began after the first `began` commits. Conflicts leave
        nothing behind; where another process takes the next number first, its commit is checked against as well."""
        self.check()
        key = list(table.primary_key)
        while True:
            self.refresh()
            newer = self._markers[began:]
            if any(m.table_id == table.id for m in newer):
                log = self.log(table, began).where("__op <> 'R'").select(*(f"`{k}`" for k in key))
                if not pending.join(log, key, "left_semi").isEmpty():
                    raise WriteConflict("a key was written after this transaction began")
            if any(m.txn_id == txn_id for m in newer):  # another process gave out the same id
                self.last_txn += 1
                txn_id = self.last_txn
            commit_ts, n = max(self.last_ts, start_ts) + 1, len(self._markers) + 1
            folder = f"t{table.id}/log/{commit_ts:020d}-{uuid.uuid4().hex}"
            try:
                versions.stamped(pending, start_ts, commit_ts, txn_id).select(*(f"`{c}`" for c in table.log_schema.names)).write.parquet(f"{self.root}/{folder}")
                rows = self.spark.read.schema(table.log_schema).parquet(f"{self.root}/{folder}").count()
            except Exception as e:
                raise CommitNotStaged("the commit's data could not be written") from e
            m = Marker(n, commit_ts, start_ts, txn_id, table.id, table.version, rows, folder)
            try:
                won = self.files.create(f"commits/{n:020d}.json", m.to_json())
            except Exception as e:
                self.poisoned = e
                raise CommitOutcomeUnknown("commit outcome is unknown; reopen the store before trying again") from e
            if won:
                self._markers.append(m)
                self.last_ts = commit_ts
                return commit_ts, rows
            self.files.delete(folder)

    # checkpoints

    def checkpoint(self) -> int:
        """Writes every table's rows as of a new timestamp; data first, marker last. Returns the timestamp."""
        self.check()
        self.refresh()
        self.last_ts += 1
        ts, n, tables = self.last_ts, len(self._markers), {}
        for table in self.catalog.tables():
            path = f"{self.root}/t{table.id}/ckpt/{ts:020d}"
            keys = [f"`{k}`" for k in table.primary_key]
            self.snapshot(table, until=n).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
            tables[str(table.id)] = self._digest(table, path)
        marker = {"ts": ts, "n": n, "tables": tables, "max_ts": ts, "max_txn_id": self.last_txn, "next_table_id": self.catalog.next_id}
        if not self.files.create(f"ckpts/{ts:020d}.json", json.dumps(marker)):
            raise InvalidArgument("a checkpoint with this timestamp exists")
        return ts

    def _digest(self, table: Table, path: str) -> list[int]:
        """Rows of a checkpoint and an order-free checksum of their values."""
        rows = self.spark.read.schema(table.log_schema).parquet(path)
        return list(rows.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*(f"`{n}`" for n in table.names))), F.lit(0))).first())

    def verify_checkpoint(self, ts: int) -> None:
        """Raises where a checkpoint's rows are not what its marker says."""
        c = next((c for c in self.checkpoints() if c["ts"] == ts), None)
        if c is None:
            raise InvalidArgument("no such checkpoint")
        for id_, digest in c["tables"].items():
            table = self.catalog.by_id(int(id_))
            if table is None or self._digest(table, f"{self.root}/t{id_}/ckpt/{ts:020d}") != digest:
                raise CorruptData(f"checkpoint {ts} of table {id_} is damaged")

    def verify(self, table: Table) -> dict[str, int]:
        """Numbers of faults in a table's log: broken timestamps, keys with NULL, NOT NULL columns of puts with NULL,
        commits whose rows are not as many as the marker says."""
        log = self.log(table)
        null = lambda names: F.coalesce(F.greatest(F.lit(False), *(F.col(f"`{n}`").isNull() for n in names)), F.lit(False))
        required = [c.name for c in table.columns if not c.nullable]
        counted = {r["__commit_ts"]: r["count"] for r in log.groupBy("__commit_ts").count().collect()}
        return {
            "timestamps": versions.malformed(log).count(),
            "null_keys": log.where(null(table.primary_key)).count(),
            "null_values": log.where((F.col("__op") == "P") & null(required)).count(),
            "row_counts": sum(counted.get(m.commit_ts, 0) != m.rows for m in self.markers() if m.table_id == table.id),
        }
