"""Which checkpoint to start from, what to replay, and what a log must not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import META, snapshot


def select_checkpoint(pointers: DataFrame, markers: DataFrame) -> DataFrame:
    """The newest pointer that a later marker confirms in all its fields; none if no pair matches.

    pointers and markers: snapshot_id, snapshot_ts, replay_from, lsn. A pointer alone is an orphan and is ignored.
    """
    fields = ["snapshot_id", "snapshot_ts", "replay_from"]
    pairs = pointers.join(markers.select(*fields, F.col("lsn").alias("marker_lsn")), fields).where("marker_lsn > lsn")
    best = pairs.groupBy(*fields, "lsn").agg(F.min("marker_lsn").alias("marker_lsn"))
    return best.orderBy(F.desc("lsn")).limit(1)


def replay(base: DataFrame, frontier: int, log: DataFrame, key: list[str]) -> DataFrame:
    """Rows visible after the checkpoint's rows and the log's commits beyond its frontier."""
    typed = {"__op": F.lit("P"), "__start_ts": F.lit(0).cast("bigint"), "__commit_ts": F.lit(frontier).cast("bigint"), "__txn_id": F.lit(0).cast("bigint")}
    state = base.withColumns(typed).select(*log.columns)
    return snapshot(state.unionByName(log.where(F.col("__commit_ts") > frontier)), key)


def reused_identities(commits: DataFrame) -> DataFrame:
    """Transaction ids and commit timestamps that more than one commit claims: kind, value, commits."""
    out = None
    for kind, c in (("txn_id", "__txn_id"), ("commit_ts", "__commit_ts")):
        other = "__commit_ts" if c == "__txn_id" else "__txn_id"
        part = commits.groupBy(F.col(c).alias("value")).agg(F.count_distinct(other).alias("commits")).where("commits > 1").select(F.lit(kind).alias("kind"), "value", "commits")
        out = part if out is None else out.unionByName(part)
    return out


def out_of_schema(log: DataFrame, known_tables: DataFrame) -> DataFrame:
    """Commit records of tables, or of schema versions, that the catalog does not know: table_id, schema_version."""
    return log.select("table_id", "schema_version").distinct().join(known_tables, ["table_id", "schema_version"], "left_anti")


def faulty_commits(log: DataFrame, key: list[str]) -> DataFrame:
    """Commit records that recovery refuses, with the reason: several tables, a key twice, or commit_ts not after a
    positive start_ts. log: table_id, key, __txn_id, __start_ts, __commit_ts."""
    keys = F.struct(F.col("table_id"), *(F.col(f"`{k}`") for k in key))
    c = log.groupBy("__txn_id").agg(F.count_distinct("table_id").alias("tables"), F.count("*").alias("n"), F.count_distinct(keys).alias("keys"), F.min(F.col("__commit_ts") - F.col("__start_ts")).alias("gap"), F.min("__start_ts").alias("start"))
    reason = F.when(F.col("tables") > 1, "tables").when(F.col("n") > F.col("keys"), "keys").when((F.col("gap") <= 0) | (F.col("start") <= 0), "timestamps")
    return c.select("__txn_id", reason.alias("reason")).where("reason is not null")


def shared_suffix(log: DataFrame, floor: int) -> tuple[DataFrame, DataFrame]:
    """One log of two owners: (database records at or above the checkpoint's floor, all replica records)."""
    return log.where((F.col("owner") == "database") & (F.col("lsn") >= floor)), log.where(F.col("owner") == "replica")


def floors(log: DataFrame) -> DataFrame:
    """One row: the next free transaction id and timestamp after everything in the log."""
    at = F.greatest("__start_ts", "__commit_ts")
    return log.agg((F.coalesce(F.max("__txn_id"), F.lit(0)) + 1).alias("next_txn_id"), (F.coalesce(F.max(at), F.lit(0)) + 1).alias("next_ts"))


def visible_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in META]
