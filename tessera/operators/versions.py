"""Multi-version reads, checks and writes as DataFrame computations over a version log.

A version is a row of its table with __op ('P' put, 'D' delete, 'R' rolled back), __start_ts, __commit_ts, __txn_id.
Puts and deletes have __commit_ts > __start_ts > 0, rollbacks __commit_ts = __start_ts. Intents are rows with __op,
__txn_id, __start_ts and __ttl_ms that are not committed yet. Pending writes are rows with __op, one a key.

Every function takes and returns DataFrames and runs no action unless it says so. Per-key work is an aggregation
that combines on the map side (max_by over a struct), so a key with many versions is one row a task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, CorruptData, WriteConflict
from ..types import Table

META = ["__op", "__start_ts", "__commit_ts", "__txn_id"]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def payload(rows: DataFrame, key: list[str]) -> list[str]:
    """Columns besides the key and the engine's own."""
    return [c for c in rows.columns if c not in key and not c.startswith("__")]


def latest(versions: DataFrame, key: list[str], read_ts: int | None = None) -> DataFrame:
    """Of each key the newest version that is not rolled back, up to read_ts: key, payload and META."""
    rows = versions.where("__op <> 'R'")
    if read_ts is not None:
        rows = rows.where(F.col("__commit_ts") <= read_ts)
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*map(_c, key)).agg(F.max_by(F.struct(*map(_c, rest)), "__commit_ts").alias("__v"))
    return newest.select(*map(_c, key), *(F.col("__v").getField(c).alias(c) for c in rest)).select(*map(_c, versions.columns))


def snapshot(versions: DataFrame, key: list[str], read_ts: int | None = None) -> DataFrame:
    """The rows visible at read_ts: newest version a put; deleted and rolled-back keys are absent."""
    return latest(versions, key, read_ts).where("__op = 'P'").drop(*META)


def tombstones(versions: DataFrame, key: list[str], read_ts: int | None = None) -> DataFrame:
    """Keys whose newest version up to read_ts is a delete."""
    return latest(versions, key, read_ts).where("__op = 'D'").select(*map(_c, key))


def overlay(visible: DataFrame, pending: DataFrame, key: list[str]) -> DataFrame:
    """What a transaction reads: its puts replace or add rows, its deletes hide them."""
    puts = pending.where("__op = 'P'").select(*map(_c, visible.columns))
    return visible.join(pending.select(*map(_c, key)), key, "left_anti").select(*map(_c, visible.columns)).unionByName(puts)


def merge_pending(pending: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Pending writes after a statement's: the last write of a key stays."""
    return pending.join(new.select(*map(_c, key)), key, "left_anti").select(*map(_c, new.columns)).unionByName(new)


def locked(keys: DataFrame, intents: DataFrame, key: list[str], read_ts: int) -> DataFrame:
    """Keys whose read at read_ts meets an intent that started by then, with or without versions."""
    held = intents.where(F.col("__start_ts") <= read_ts).select(*map(_c, key))
    return keys.select(*map(_c, key)).distinct().join(held, key, "left_semi")


def conflicts(pending: DataFrame, versions: DataFrame, key: list[str], start_ts: int) -> DataFrame:
    """Pending keys that someone wrote after start_ts, or whose own start was rolled back."""
    newer = versions.where(((F.col("__commit_ts") > start_ts) & (F.col("__op") != "R")) | ((F.col("__start_ts") == start_ts) & (F.col("__op") == "R")))
    return pending.select(*map(_c, key)).join(newer.select(*map(_c, key)), key, "left_semi")


def foreign_locks(pending: DataFrame, intents: DataFrame, key: list[str], txn_id: int) -> DataFrame:
    """Pending keys that another transaction's intent holds."""
    return pending.select(*map(_c, key)).join(intents.where(F.col("__txn_id") != txn_id).select(*map(_c, key)), key, "left_semi")


def stale_commit(pending: DataFrame, versions: DataFrame, key: list[str], commit_ts: int) -> DataFrame:
    """Pending keys that already have a version at commit_ts or later."""
    return pending.select(*map(_c, key)).join(versions.where(F.col("__commit_ts") >= commit_ts).select(*map(_c, key)), key, "left_semi")


def stamped(pending: DataFrame, start_ts: int, commit_ts: int, txn_id: int) -> DataFrame:
    """Pending writes as versions."""
    return pending.withColumns({"__start_ts": F.lit(start_ts).cast("bigint"), "__commit_ts": F.lit(commit_ts).cast("bigint"), "__txn_id": F.lit(txn_id).cast("bigint")})


def _against(pending: DataFrame, held: DataFrame, key: list[str], how: str = "inner") -> tuple[DataFrame, Column]:
    """Pending writes joined by key with rows that are held, and whether such a row is the same write: op and, for a
    put, every payload column. Of a held row __op is __held, other columns have a prefix __h_."""
    names = payload(held, key)
    meta = [c for c in held.columns if c in META]
    row = [_c(c).alias(f"__h_{c}") for c in names] + [_c(c).alias("__held" if c == "__op" else c) for c in meta]
    same = (F.col("__held") == F.col("__op")) & ((F.col("__op") != "P") | F.greatest(F.lit(False), *(~_c(c).eqNullSafe(_c(f"__h_{c}")) for c in names)).eqNullSafe(False)) if names else F.col("__held") == F.col("__op")
    return pending.select(*map(_c, key), *map(_c, names), "__op").join(held.select(*map(_c, key), *row), key, how), same


def _many(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")), F.lit(0).cast("bigint")).alias(name)


def replayed(pending: DataFrame, versions: DataFrame, key: list[str], start_ts: int, commit_ts: int) -> DataFrame:
    """One row: writes, present = how many of them the log holds from just this commit, with the same op and row, and
    occupied = how many keys hold anything else at this commit timestamp."""
    rows, same = _against(pending, versions.where(F.col("__commit_ts") == commit_ts), key, "left")
    same = F.coalesce(same & (F.col("__start_ts") == start_ts), F.lit(False))
    return rows.agg(F.count("*").alias("writes"), _many(same, "present"), _many(F.col("__held").isNotNull() & ~same, "occupied"))


def lock_faults(pending: DataFrame, intents: DataFrame, key: list[str], start_ts: int, txn_id: int) -> DataFrame:
    """One row: how many pending keys another transaction's intent holds (locked), how many have the transaction's own
    intent with another op or row (changed), and how many have just this write as an intent (own)."""
    rows, same = _against(pending, intents, key)
    mine = (F.col("__txn_id") == txn_id) & (F.col("__start_ts") == start_ts)
    return rows.agg(_many(~mine, "locked"), _many(mine & ~same, "changed"), _many(mine & same, "own"))


def history_faults(pending: DataFrame, versions: DataFrame, key: list[str], start_ts: int, txn_id: int, commit_ts: int | None = None) -> DataFrame:
    """One row, one look at the log: how many versions conflict with a commit that began at start_ts, how many are at
    commit_ts or later (stale), and how many the same transaction left at start_ts with another op or row (changed)."""
    recent = versions.where((F.col("__commit_ts") > start_ts) | (F.col("__start_ts") == start_ts))
    rows, same = _against(pending, recent, key)
    rolled = F.col("__held") == "R"
    newer = ((F.col("__commit_ts") > start_ts) & ~rolled) | ((F.col("__start_ts") == start_ts) & rolled)
    stale = F.lit(False) if commit_ts is None else F.col("__commit_ts") >= commit_ts
    changed = (F.col("__start_ts") == start_ts) & (F.col("__txn_id") == txn_id) & ~rolled & ~same
    return rows.agg(_many(newer, "newer"), _many(stale, "stale"), _many(changed, "changed"))


def preflight(pending: DataFrame, versions: DataFrame, intents: DataFrame | None, key: list[str], start_ts: int, txn_id: int, commit_ts: int | None = None) -> None:
    """Runs the checks of a commit, a look at the intents and one at the log; raises CorruptData where the transaction
    itself left another write of a key, else WriteConflict. Changes nothing."""
    if intents is not None:
        held = lock_faults(pending, intents, key, start_ts, txn_id).first()
        if held.changed:
            raise CorruptData("the transaction holds a key with another write")
        if held.locked:
            raise WriteConflict("a key is locked by another transaction")
    found = history_faults(pending, versions, key, start_ts, txn_id, commit_ts).first()
    if found.changed:
        raise CorruptData("the transaction wrote a key differently before")
    if found.newer:
        raise WriteConflict("a key was written after this transaction began")
    if found.stale:
        raise WriteConflict("a key has a version at or after the commit timestamp")


def apply_commit(versions: DataFrame, pending: DataFrame, key: list[str], start_ts: int, commit_ts: int, txn_id: int, intents: DataFrame | None = None) -> DataFrame:
    """The log after an atomic commit. A commit that is already there whole changes nothing; in part, or with another
    op or row, it is corrupt. released() gives the intents after it."""
    if not 0 < start_ts < commit_ts:
        raise ConstraintViolation("a commit needs 0 < start_ts < commit_ts")
    r = replayed(pending, versions, key, start_ts, commit_ts).first()
    if r.occupied:
        raise CorruptData("the log holds another write at the commit timestamp")
    if r.present:
        if r.present != r.writes:
            raise CorruptData("the log holds a part of this commit")
        return versions
    preflight(pending, versions, intents, key, start_ts, txn_id, commit_ts)
    return versions.unionByName(stamped(pending, start_ts, commit_ts, txn_id).select(*map(_c, versions.columns)))


def released(intents: DataFrame, pending: DataFrame, key: list[str], start_ts: int, txn_id: int) -> DataFrame:
    """Intents without the transaction's own on the keys that it has committed."""
    own = (F.col("__txn_id") == txn_id) & (F.col("__start_ts") == start_ts)
    marked = intents.join(pending.select(*map(_c, key), F.lit(True).alias("__done")), key, "left")
    return marked.where(~(own & F.coalesce("__done", F.lit(False)))).select(*map(_c, intents.columns))


# intents: prewrite, commit, roll back


def prewrite(intents: DataFrame, versions: DataFrame, pending: DataFrame, key: list[str], start_ts: int, txn_id: int, ttl_ms: int) -> DataFrame:
    """Intents after the prewrite. The same prewrite again changes nothing; with another op or row it is corrupt."""
    if ttl_ms <= 0 or start_ts <= 0:
        raise ConstraintViolation("an intent needs a start timestamp and a time to live")
    if lock_faults(pending, intents, key, start_ts, txn_id).first().own == pending.count():
        return intents
    preflight(pending, versions, intents, key, start_ts, txn_id)
    new = pending.withColumns({"__start_ts": F.lit(start_ts).cast("bigint"), "__txn_id": F.lit(txn_id).cast("bigint"), "__ttl_ms": F.lit(ttl_ms).cast("bigint")})
    rest = intents.join(pending.select(*map(_c, key)), key, "left_anti")
    return rest.select(*map(_c, intents.columns)).unionByName(new.select(*map(_c, intents.columns)))


def _own(intents: DataFrame, keys: DataFrame, key: list[str], start_ts: int, txn_id: int) -> DataFrame:
    return intents.where((F.col("__txn_id") == txn_id) & (F.col("__start_ts") == start_ts)).join(keys.select(*map(_c, key)), key, "left_semi")


def commit_intents(intents: DataFrame, versions: DataFrame, keys: DataFrame, key: list[str], start_ts: int, commit_ts: int, txn_id: int) -> tuple[DataFrame, DataFrame]:
    """(intents, versions) after the keys' intents became versions. A replay changes nothing; a missing intent is a conflict."""
    if commit_ts <= start_ts:
        raise ConstraintViolation("a commit comes after its start")
    own = _own(intents, keys, key, start_ts, txn_id)
    done = versions.where((F.col("__start_ts") == start_ts) & (F.col("__commit_ts") == commit_ts) & (F.col("__op") != "R")).select(*map(_c, key))
    missing = keys.select(*map(_c, key)).join(own.select(*map(_c, key)), key, "left_anti").join(done, key, "left_anti")
    if not missing.isEmpty():
        raise WriteConflict("an intent to commit is missing")
    new = own.withColumn("__commit_ts", F.lit(commit_ts).cast("bigint")).select(*map(_c, versions.columns))
    left = intents.join(own.select(*map(_c, key)), key, "left_anti").select(*map(_c, intents.columns))
    return left, versions.unionByName(new)


def rollback_intents(intents: DataFrame, versions: DataFrame, keys: DataFrame, key: list[str], start_ts: int, txn_id: int) -> tuple[DataFrame, DataFrame]:
    """(intents, versions) after the keys were rolled back: a rollback record at start_ts, with or without an intent."""
    at = versions.where(F.col("__start_ts") == start_ts)
    if not keys.join(at.where("__op <> 'R'"), key, "left_semi").isEmpty():
        raise WriteConflict("the transaction is committed on a key")
    new = keys.select(*map(_c, key)).distinct().join(at.where("__op = 'R'").select(*map(_c, key)), key, "left_anti")
    blank = [F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in payload(versions, key)]
    record = new.select(*map(_c, key), *blank, F.lit("R").alias("__op"), *(F.lit(v).cast("bigint").alias(n) for n, v in (("__start_ts", start_ts), ("__commit_ts", start_ts), ("__txn_id", txn_id))))
    left = intents.join(_own(intents, keys, key, start_ts, txn_id).select(*map(_c, key)), key, "left_anti").select(*map(_c, intents.columns))
    return left, versions.unionByName(record.select(*map(_c, versions.columns)))


# checks and statistics


def dangling_puts(writes: DataFrame, payloads: DataFrame, key: list[str]) -> DataFrame:
    """Of logs that keep rows apart: puts whose (key, __start_ts) has no row. They are corruption, never absent rows."""
    return writes.where("__op = 'P'").join(payloads.select(*map(_c, key), "__start_ts"), [*key, "__start_ts"], "left_anti")


def malformed(versions: DataFrame) -> DataFrame:
    """Versions that break the timestamp invariants."""
    ok = F.when(F.col("__op") == "R", F.col("__commit_ts") == F.col("__start_ts")).otherwise((F.col("__op").isin("P", "D")) & (F.col("__commit_ts") > F.col("__start_ts")) & (F.col("__start_ts") > 0))
    return versions.where(~F.coalesce(ok, F.lit(False)))


def invalid_rows(rows: DataFrame, table: Table) -> DataFrame:
    """Rows that no write could have left: NULL in a key or in a column that is not nullable."""
    required = [_c(c.name).isNull() for c in table.columns if not c.nullable]
    return rows.where(F.greatest(F.lit(False), *required)) if required else rows.limit(0)


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys with several rows in one statement."""
    return rows.groupBy(*map(_c, key)).agg(F.count("*").alias("n")).where("n > 1").select(*map(_c, key))


def statistics(versions: DataFrame, intents: DataFrame | None, key: list[str]) -> DataFrame:
    """One row: distinct keys, versions that carry a row, write records and locks."""
    rows = versions.select(F.struct(*map(_c, key)).alias("k"), (F.col("__op") == "P").cast("bigint").alias("put"), F.lit(1).cast("bigint").alias("record"), F.lit(0).cast("bigint").alias("lock"))
    if intents is not None:
        none = F.lit(None).cast(rows.schema["k"].dataType)
        rows = rows.unionByName(intents.select(none.alias("k"), F.lit(0).cast("bigint").alias("put"), F.lit(0).cast("bigint").alias("record"), F.lit(1).cast("bigint").alias("lock")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(F.count_distinct("k").alias("distinct_keys"), total("put").alias("row_versions"), total("record").alias("write_records"), total("lock").alias("locks"))


def high_water(versions: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """One row: the largest transaction id and timestamp anywhere, 0 where there is none."""
    rows = versions.select("__txn_id", F.greatest("__start_ts", "__commit_ts").alias("__ts"))
    if intents is not None:
        rows = rows.unionByName(intents.select("__txn_id", F.col("__start_ts").alias("__ts")))
    return rows.agg(F.coalesce(F.max("__txn_id"), F.lit(0)).alias("max_txn_id"), F.coalesce(F.max("__ts"), F.lit(0)).alias("max_ts"))
