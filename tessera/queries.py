"""The engine's queries, one or more for each operator, and the SQL that must give the same rows.

SELECT queries go through parser, binder and compiler. The others call the operators on versions, intents, commits
and commands that are derived from the driver's tables; what is derived is spelled out on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .operators import commands, dml, recovery, versions
from .plans import binder, parser
from .sources.external import External

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Columns that the tables lack: NULLs and booleans to test three-valued logic on.
DERIVED = {
    "events": {"maybe_user": ("CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END", "INT"), "is_error": ("event_type = 'error'", "BOOL"), "maybe_flag": ("CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type = 'click' END", "BOOL")},
    "labels": {"good": ("quality = 1", "BOOL"), "bad": ("toxic = 1", "BOOL")},
}
_EVENTS = "(SELECT event_id, CAST(user_id AS BIGINT) AS user_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS maybe_user, event_type = 'error' AS is_error, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type = 'click' END AS maybe_flag FROM events)"


def _select(name: str, text: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: External(spark, sf_dir, DERIVED).sql(text)
    SQL[name] = oracle or text


def _operator(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_PART = "(SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, p_name, p_brand, p_type FROM part)"
_select("select_star", "SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
_select("select_star_and_columns", "SELECT c_custkey, c_name FROM customer")
_select("project_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
_select("quoted_names", 'SELECT "o_orderkey", O_ORDERSTATUS FROM Orders WHERE "o_custkey" = 7', "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7")
_select("flagship_orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey < 100 AND o_orderstatus = 'O'")
_select("filter_eq_text", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
_select("filter_neq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
for _name, _op in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    _select(f"filter_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 10", f"SELECT p_partkey, p_size FROM {_PART} WHERE p_size {_op} 10")
_select("filter_text_order", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'F'")
_select("filter_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 500")
_select("filter_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey > 500")
_select("filter_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_custkey > 500)")
_select("arith_add_sub_mul", "SELECT p_partkey, p_size FROM part WHERE p_size * 2 + p_partkey - 3 > 100", f"SELECT p_partkey, p_size FROM {_PART} WHERE p_size * 2 + p_partkey - 3 > 100")
_select("arith_div", "SELECT p_partkey FROM part WHERE (p_partkey - 100) / 7 = -3", f"SELECT p_partkey FROM {_PART} WHERE (p_partkey - 100) // 7 = -3")
_select("arith_mod", "SELECT p_partkey FROM part WHERE (p_partkey - 1000) % 7 = -1", f"SELECT p_partkey FROM {_PART} WHERE (p_partkey - 1000) % 7 = -1")
_select("unary_minus", "SELECT p_partkey FROM part WHERE -p_partkey < -100", f"SELECT p_partkey FROM {_PART} WHERE -p_partkey < -100")
_select("unary_plus", "SELECT p_partkey FROM part WHERE +p_partkey > 100 AND p_size > - 5", f"SELECT p_partkey FROM {_PART} WHERE p_partkey > 100 AND p_size > -5")
_select("int_extremes", "SELECT p_partkey FROM part WHERE p_partkey > -9223372036854775808 AND p_partkey <> 9223372036854775807", f"SELECT p_partkey FROM {_PART}")
_select("is_null", "SELECT event_id FROM events WHERE maybe_user IS NULL", f"SELECT event_id FROM {_EVENTS} WHERE maybe_user IS NULL")
_select("is_not_null", "SELECT event_id, maybe_user FROM events WHERE maybe_user IS NOT NULL", f"SELECT event_id, maybe_user FROM {_EVENTS} WHERE maybe_user IS NOT NULL")
_select("null_comparison_drops", "SELECT event_id FROM events WHERE maybe_user > 50", f"SELECT event_id FROM {_EVENTS} WHERE maybe_user > 50")
_select("three_valued_and", "SELECT event_id FROM events WHERE maybe_flag AND NOT is_error", f"SELECT event_id FROM {_EVENTS} WHERE maybe_flag AND NOT is_error")
_select("three_valued_or", "SELECT event_id FROM events WHERE maybe_flag OR is_error", f"SELECT event_id FROM {_EVENTS} WHERE maybe_flag OR is_error")
_select("three_valued_not", "SELECT event_id FROM events WHERE NOT (maybe_flag AND maybe_user > 50)", f"SELECT event_id FROM {_EVENTS} WHERE NOT (maybe_flag AND maybe_user > 50)")
_select("strict_and_can_raise", "SELECT event_id FROM events WHERE is_error = false AND maybe_user / 3 > 20", f"SELECT event_id FROM {_EVENTS} WHERE is_error = false AND maybe_user // 3 > 20")
_select("strict_or_can_raise", "SELECT event_id FROM events WHERE is_error OR maybe_user % 5 = 1", f"SELECT event_id FROM {_EVENTS} WHERE is_error OR maybe_user % 5 = 1")
_select("filter_bool_eq", "SELECT doc_id FROM labels WHERE good = true AND bad <> true", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic <> 1")
_select("point_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42")
_select("point_lookup_composite", "SELECT conv_id, turn, role FROM conversations WHERE turn = 1 AND conv_id = 5", "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role FROM conversations WHERE turn = 1 AND conv_id = 5")
_select("partial_key_scan", "SELECT turn, role FROM conversations WHERE conv_id = 5", "SELECT CAST(turn AS BIGINT) AS turn, role FROM conversations WHERE conv_id = 5")
_select("empty_contradiction", "SELECT o_orderkey FROM orders WHERE o_orderkey = 1 AND o_orderkey = 2")
_select("empty_never_raises", "SELECT o_orderkey FROM orders WHERE o_orderkey = 1 AND o_orderkey = 2 AND 1 / 0 = 1", "SELECT o_orderkey FROM orders WHERE false")
_select("point_guards_errors", "SELECT o_orderkey FROM orders WHERE o_orderkey = 42 AND 1000 / (o_orderkey - 41) = 1000", "SELECT o_orderkey FROM orders WHERE o_orderkey = 42")
_select("range_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
_select("full_scan_lineitem", "SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag FROM lineitem")
_select("filtered_lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber >= 3", "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber >= 3")

# versions: an event is a version of its user; errors delete, views are rolled back

KEY = ["user_id"]
READ_TS, START_TS = 10_000, 12_000
_V = "v AS (SELECT CAST(user_id AS BIGINT) AS user_id, event_type, CASE event_type WHEN 'error' THEN 'D' WHEN 'view' THEN 'R' ELSE 'P' END AS op, 2 * event_id + 1 AS s, 2 * event_id + CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS c, event_id + 1 AS t FROM events)"
_N = "n AS (SELECT * FROM v WHERE op <> 'R' AND c <= {ts} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC) = 1)"
_P = "p AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, CASE WHEN user_id % 7 = 0 THEN 'P' ELSE 'D' END AS op FROM events WHERE user_id % 7 < 2)"
_I = "i AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, 100 * CAST(user_id AS BIGINT) + 1 AS s, CAST(user_id AS BIGINT) + 5 AS t FROM events WHERE user_id % 5 = 0)"


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("bigint"), "event_type", F.col("event_id").cast("bigint"))
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "view", "R").otherwise("P")
    start = 2 * F.col("event_id") + 1
    return e.select("user_id", "event_type", op.alias("__op"), start.alias("__start_ts"), F.when(op == "R", start).otherwise(start + 1).alias("__commit_ts"), (F.col("event_id") + 1).alias("__txn_id"))


def pending_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = event_versions(spark, sf_dir).select("user_id").distinct().where("user_id % 7 < 2")
    put = F.col("user_id") % 7 == 0
    return users.select("user_id", F.when(put, "pending").alias("event_type"), F.when(put, "P").otherwise("D").alias("__op"))


def event_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = event_versions(spark, sf_dir).select("user_id").distinct().where("user_id % 5 = 0")
    return users.select("user_id", F.lit("intent").alias("event_type"), F.lit("P").alias("__op"), (100 * F.col("user_id") + 1).alias("__start_ts"), (F.col("user_id") + 5).alias("__txn_id"), F.lit(1000).cast("bigint").alias("__ttl_ms"))


@_operator("mvcc_snapshot_read", f"WITH {_V}, {_N.format(ts=READ_TS)} SELECT user_id, event_type FROM n WHERE op = 'P'")
def _(spark, d):
    return versions.snapshot(event_versions(spark, d), KEY, READ_TS)


@_operator("mvcc_snapshot_point", f"WITH {_V}, {_N.format(ts=READ_TS)} SELECT user_id, event_type FROM n WHERE op = 'P' AND user_id = 17")
def _(spark, d):
    return versions.snapshot(event_versions(spark, d), KEY, READ_TS).where("user_id = 17")


@_operator("mvcc_tombstone", f"WITH {_V}, {_N.format(ts=READ_TS)} SELECT user_id FROM n WHERE op = 'D'")
def _(spark, d):
    return versions.tombstones(event_versions(spark, d), KEY, READ_TS)


@_operator("txn_overlay", f"WITH {_V}, {_N.format(ts=READ_TS)}, {_P} SELECT user_id, event_type FROM n WHERE op = 'P' AND user_id NOT IN (SELECT user_id FROM p) UNION ALL SELECT user_id, 'pending' FROM p WHERE op = 'P'")
def _(spark, d):
    return versions.overlay(versions.snapshot(event_versions(spark, d), KEY, READ_TS), pending_writes(spark, d), KEY)


@_operator("txn_merge_pending", f"WITH {_P} SELECT user_id, op AS __op FROM p WHERE user_id % 2 = 1 UNION ALL SELECT user_id, 'D' FROM p WHERE user_id % 2 = 0")
def _(spark, d):
    p = pending_writes(spark, d)
    return versions.merge_pending(p, p.where("user_id % 2 = 0").withColumn("__op", F.lit("D")), KEY).select("user_id", "__op")


@_operator("mvcc_locked_keys", f"WITH {_V}, {_I} SELECT DISTINCT user_id FROM v WHERE user_id IN (SELECT user_id FROM i WHERE s <= {READ_TS})")
def _(spark, d):
    return versions.locked(event_versions(spark, d), event_intents(spark, d), KEY, READ_TS)


@_operator("mvcc_conflict_check", f"WITH {_V}, {_P} SELECT user_id FROM p WHERE user_id IN (SELECT user_id FROM v WHERE (c > {START_TS} AND op <> 'R') OR (s = {START_TS} AND op = 'R'))")
def _(spark, d):
    return versions.conflicts(pending_writes(spark, d), event_versions(spark, d), KEY, START_TS)


@_operator("mvcc_foreign_locks", f"WITH {_P}, {_I} SELECT user_id FROM p WHERE user_id IN (SELECT user_id FROM i WHERE t <> 12)")
def _(spark, d):
    return versions.foreign_locks(pending_writes(spark, d), event_intents(spark, d), KEY, 12)


@_operator("mvcc_commit_ts_check", f"WITH {_V}, {_P} SELECT user_id FROM p WHERE user_id IN (SELECT user_id FROM v WHERE c >= {START_TS})")
def _(spark, d):
    return versions.stale_commit(pending_writes(spark, d), event_versions(spark, d), KEY, START_TS)


@_operator("mvcc_apply_commit", f"WITH {_V}, {_P} SELECT user_id, op AS __op, s AS __start_ts, c AS __commit_ts, t AS __txn_id FROM v UNION ALL SELECT user_id, op, 900001, 900002, 77 FROM p")
def _(spark, d):
    v = event_versions(spark, d)
    later = F.coalesce(F.col("__commit_ts") >= 900_001, F.lit(False))  # events from 450000 on; the commit meets the log before them, they follow it
    log = versions.apply_commit(v.where(~later), pending_writes(spark, d), KEY, 900_001, 900_002, 77)
    return log.unionByName(v.where(later)).drop("event_type")


@_operator("mvcc_replay_check", f"WITH {_V} SELECT (SELECT count(*) FROM v WHERE s = 2001) + 1 AS writes, (SELECT count(*) FROM v WHERE s = 2001 AND c = 2002) AS present")
def _(spark, d):
    v = event_versions(spark, d)
    own = v.where("__start_ts = 2001").select("user_id", "event_type", "__op")
    other = spark.createDataFrame([(-1, "x", "P")], own.schema)
    return versions.replayed(own.unionByName(other), v, KEY, 2001, 2002).select("writes", "present")


@_operator("mvcc_replay_payload", f"WITH {_V} SELECT count(*) AS writes, CAST(0 AS BIGINT) AS present, count(*) AS occupied FROM v WHERE op = 'P' AND s = (SELECT min(s) FROM v WHERE op = 'P' AND s >= 201)")
def _(spark, d):
    v = event_versions(spark, d)
    first = v.where("__op = 'P' AND __start_ts >= 201").agg(F.min("__start_ts")).first()[0]
    own = v.where((F.col("__start_ts") == first) & (F.col("__op") == "P")).select("user_id", F.lit("another").alias("event_type"), "__op")
    return versions.replayed(own, v, KEY, first, first + 1)


@_operator("intent_op_mismatch", f"WITH {_I} SELECT count(*) FILTER (user_id <> 10) AS locked, count(*) FILTER (user_id = 10) AS changed, CAST(0 AS BIGINT) AS own FROM i")
def _(spark, d):
    i = event_intents(spark, d)
    return versions.lock_faults(i.select("user_id", "event_type", F.lit("D").alias("__op")), i, KEY, 1001, 15)


@_operator("mvcc_commit_drops_own_locks", f"WITH {_I} SELECT user_id, s AS __start_ts FROM i WHERE user_id <> 10")
def _(spark, d):
    i = event_intents(spark, d)
    return versions.released(i, i.select("user_id", "event_type", "__op"), KEY, 1001, 15).select("user_id", "__start_ts")


@_operator("intent_prewrite", f"WITH {_I}, {_P} SELECT user_id, s AS __start_ts, t AS __txn_id FROM i UNION ALL SELECT user_id + 1000000, 900001, 77 FROM p")
def _(spark, d):
    p = pending_writes(spark, d).withColumn("user_id", F.col("user_id") + 1_000_000)
    return versions.prewrite(event_intents(spark, d), event_versions(spark, d), p, KEY, 900_001, 77, 500).select("user_id", "__start_ts", "__txn_id")


@_operator("intent_commit", f"WITH {_V}, {_I} SELECT 'intent' AS what, user_id, s AS __start_ts FROM i WHERE user_id <> 10 UNION ALL SELECT 'version', user_id, s FROM v UNION ALL SELECT 'version', user_id, s FROM i WHERE user_id = 10")
def _(spark, d):
    i = event_intents(spark, d)
    left, log = versions.commit_intents(i, event_versions(spark, d), i.where("user_id = 10"), KEY, 1001, 900_002, 15)
    return left.select(F.lit("intent").alias("what"), "user_id", "__start_ts").unionByName(log.select(F.lit("version").alias("what"), "user_id", "__start_ts"))


@_operator("intent_rollback", f"WITH {_V}, {_I} SELECT 'intent' AS what, user_id, s AS __start_ts, 'P' AS __op FROM i WHERE user_id <> 10 UNION ALL SELECT 'version', user_id, s, op FROM v UNION ALL SELECT 'version', * FROM (VALUES (10, 800000, 'R'), (2000000, 800000, 'R'))")
def _(spark, d):
    i = event_intents(spark, d).withColumn("__start_ts", F.when(F.col("user_id") == 10, 800_000).otherwise(F.col("__start_ts")))
    asked = spark.createDataFrame([(10,), (2_000_000,)], "user_id long")
    left, log = versions.rollback_intents(i, event_versions(spark, d), asked, KEY, 800_000, 15)
    return left.select(F.lit("intent").alias("what"), "user_id", "__start_ts", "__op").unionByName(log.select(F.lit("version").alias("what"), "user_id", "__start_ts", "__op"))


@_operator("mvcc_dangling_put", f"WITH {_V} SELECT user_id, s AS __start_ts FROM v WHERE op = 'P' AND t % 11 = 0")
def _(spark, d):
    v = event_versions(spark, d)
    return versions.dangling_puts(v, v.where("__txn_id % 11 <> 0"), KEY).select("user_id", "__start_ts")


@_operator("mvcc_write_invariant", f"WITH {_V} SELECT user_id, s AS __start_ts FROM v WHERE op <> 'R' AND t % 13 = 0")
def _(spark, d):
    v = event_versions(spark, d)
    return versions.malformed(v.withColumn("__commit_ts", F.when(F.col("__txn_id") % 13 == 0, F.col("__start_ts")).otherwise(F.col("__commit_ts")))).select("user_id", "__start_ts")


@_operator("mvcc_stats", f"WITH {_V}, {_I} SELECT count(DISTINCT user_id) AS distinct_keys, count(*) FILTER (op = 'P') AS row_versions, count(*) AS write_records, (SELECT count(*) FROM i) AS locks FROM v")
def _(spark, d):
    return versions.statistics(event_versions(spark, d), event_intents(spark, d), KEY)


@_operator("mvcc_high_water", f"WITH {_V}, {_I} SELECT greatest((SELECT max(t) FROM v), (SELECT max(t) FROM i)) AS max_txn_id, greatest((SELECT max(greatest(s, c)) FROM v), (SELECT max(s) FROM i)) AS max_ts")
def _(spark, d):
    return versions.high_water(event_versions(spark, d), event_intents(spark, d))


@_operator("recovery_checkpoint_select", "WITH p AS (SELECT event_id AS id, 10 * event_id AS lsn FROM events WHERE event_type = 'signup'), m AS (SELECT id, lsn + 5 AS lsn FROM p WHERE id % 3 <> 0) SELECT p.id AS snapshot_id, 2 * p.id AS snapshot_ts, p.id AS replay_from, p.lsn, m.lsn AS marker_lsn FROM p JOIN m USING (id) ORDER BY p.lsn DESC LIMIT 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'signup'")
    p = e.select(F.col("event_id").alias("snapshot_id"), (2 * F.col("event_id")).alias("snapshot_ts"), F.col("event_id").alias("replay_from"), (10 * F.col("event_id")).alias("lsn"))
    m = p.withColumns({"lsn": F.col("lsn") + 5, "replay_from": F.when(F.col("snapshot_id") % 3 == 0, -1).otherwise(F.col("replay_from"))})
    return recovery.select_checkpoint(p, m)


@_operator("recovery_replay", f"WITH {_V}, {_N.format(ts=1 << 40)} SELECT user_id, event_type FROM n WHERE op = 'P'")
def _(spark, d):
    v = event_versions(spark, d)
    return recovery.replay(versions.snapshot(v, KEY, READ_TS), READ_TS, v, KEY).select("user_id", "event_type")


@_operator("recovery_duplicate_txn", f"WITH {_V}, w AS (SELECT t % 9000 AS t, c FROM v WHERE op <> 'R') SELECT 'txn_id' AS kind, t AS value, count(DISTINCT c) AS commits FROM w GROUP BY t HAVING count(DISTINCT c) > 1 UNION ALL SELECT 'commit_ts', c, count(DISTINCT t) FROM w GROUP BY c HAVING count(DISTINCT t) > 1")
def _(spark, d):
    v = event_versions(spark, d).where("__op <> 'R'")
    return recovery.reused_identities(v.withColumn("__txn_id", F.col("__txn_id") % 9000))


@_operator("recovery_unknown_schema", "SELECT DISTINCT n_regionkey AS table_id, 1 + n_nationkey % 2 AS schema_version FROM nation WHERE n_nationkey % 2 = 1 OR n_regionkey > 2")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    log = n.select(F.col("n_regionkey").alias("table_id"), (1 + F.col("n_nationkey") % 2).alias("schema_version"))
    return recovery.out_of_schema(log, n.where("n_regionkey <= 2").select(F.col("n_regionkey").alias("table_id"), F.lit(1).cast(log.schema["schema_version"].dataType).alias("schema_version")).distinct())


@_operator("recovery_floors", f"WITH {_V} SELECT max(t) + 1 AS next_txn_id, max(greatest(s, c)) + 1 AS next_ts FROM v")
def _(spark, d):
    return recovery.floors(event_versions(spark, d))


@_operator("recovery_commit_faults", "WITH l AS (SELECT o_orderkey % 2000 AS t, o_orderkey // 2000 % 3 AS tab, o_custkey AS k, o_orderkey % 7 AS s, o_orderkey % 5 + 4 AS c FROM orders), g AS (SELECT t, count(DISTINCT tab) AS tabs, count(*) AS n, count(DISTINCT (tab, k)) AS ks, min(c - s) AS gap, min(s) AS start FROM l GROUP BY t) SELECT t AS __txn_id, CASE WHEN tabs > 1 THEN 'tables' WHEN n > ks THEN 'keys' ELSE 'timestamps' END AS reason FROM g WHERE tabs > 1 OR n > ks OR gap <= 0 OR start <= 0")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    log = o.select((F.col("o_orderkey") % 2000).alias("__txn_id"), F.expr("o_orderkey div 2000 % 3").alias("table_id"), F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 7).alias("__start_ts"), (F.col("o_orderkey") % 5 + 4).alias("__commit_ts"))
    return recovery.faulty_commits(log, ["k"])


@_operator("recovery_shared_log", "SELECT event_id AS lsn, CASE WHEN event_id % 4 = 0 THEN 'replica' ELSE 'database' END AS owner FROM events WHERE event_id % 4 = 0 OR event_id >= 500")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("lsn"), F.when(F.col("event_id") % 4 == 0, "replica").otherwise("database").alias("owner"))
    database, replica = recovery.shared_suffix(e, 500)
    return database.unionByName(replica)


@_operator("row_integrity", f"SELECT event_id FROM {_EVENTS} WHERE maybe_flag IS NULL OR maybe_user IS NULL")
def _(spark, d):
    from dataclasses import replace

    source = External(spark, d, DERIVED)
    table = source.register("events")
    strict = replace(table, columns=tuple(replace(c, nullable=False) for c in table.columns))
    return versions.invalid_rows(source.read("events"), strict).select("event_id")


# commands: a turn is a request of its conversation; even turns arrive twice, turn 5 never

_CMD = "a AS (SELECT CAST(conv_id AS BIGINT) AS client, CAST(turn AS BIGINT) + 1 AS sequence, 2 * CAST(turn AS BIGINT) AS arrival FROM conversations WHERE turn <> 5 UNION ALL SELECT CAST(conv_id AS BIGINT), CAST(turn AS BIGINT) + 1, 2 * CAST(turn AS BIGINT) + 1 FROM conversations WHERE turn % 2 = 0 AND turn <> 5)"


def turn_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn <> 5").select(F.col("conv_id").cast("bigint").alias("client"), (F.col("turn").cast("bigint") + 1).alias("sequence"), (2 * F.col("turn").cast("bigint")).alias("arrival"))
    return c.unionByName(c.where("sequence % 2 = 1").withColumn("arrival", F.col("arrival") + 1))


@_operator("cmd_dedup", f"WITH {_CMD} SELECT client, sequence, arrival, CASE WHEN sequence > 6 THEN 'gap' WHEN arrival % 2 = 1 THEN 'duplicate' ELSE 'applied' END AS verdict FROM a")
def _(spark, d):
    return commands.classify(turn_commands(spark, d))


@_operator("cmd_dedup_sorted", f"WITH {_CMD}, b AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY client ORDER BY sequence), 0) AS before FROM a) SELECT client, sequence, CASE WHEN sequence = before + 1 THEN 'applied' WHEN sequence = before THEN 'duplicate' ELSE 'gap' END AS verdict FROM b")
def _(spark, d):
    return commands.classify_sorted(turn_commands(spark, d)).select("client", "sequence", "verdict")


@_operator("cmd_validation", f"WITH {_CMD} SELECT client, sequence, arrival, client % 3 = 0 AND sequence % 2 = 0 AS accepted FROM a")
def _(spark, d):
    c = turn_commands(spark, d).withColumns({"tablet_id": F.col("client") % 3, "expected_epoch": F.col("sequence") % 2, "kind": F.lit("noop")})
    ok, no = commands.valid(c, 0, 0)
    return ok.withColumn("accepted", F.lit(True)).unionByName(no.withColumn("accepted", F.lit(False))).select("client", "sequence", "arrival", "accepted")


@_operator(
    "log_view_replay",
    """WITH a AS (SELECT CAST(user_id AS BIGINT) % 10 AS replica, event_id % 50 AS i, event_id // 300 AS term, event_id AS arrival FROM events),
b AS (SELECT *, lag(term) OVER (PARTITION BY replica, i ORDER BY arrival) AS prior FROM a),
c AS (SELECT *, min(CASE WHEN prior IS NOT NULL AND prior <> term THEN i END) OVER (PARTITION BY replica ORDER BY arrival DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest FROM b)
SELECT replica, i AS "index", term, arrival FROM c WHERE lowest IS NULL OR i < lowest QUALIFY row_number() OVER (PARTITION BY replica, i ORDER BY arrival DESC) = 1""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    a = e.select((F.col("user_id").cast("bigint") % 10).alias("replica"), (F.col("event_id") % 50).alias("index"), F.expr("event_id div 300").alias("term"), F.col("event_id").alias("arrival"))
    return commands.surviving_entries(a)


@_operator("stream_dedup", f"WITH {_CMD} SELECT client, sequence FROM a WHERE sequence < 6 AND arrival % 2 = 0")
def _(spark, d):
    from .session import shared_folder
    from .streaming import commands as stream

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/conversations.parquet").schema
    c = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/conversations.parquet*").where("turn <> 5").select(F.col("conv_id").cast("bigint").alias("client"), (F.col("turn").cast("bigint") + 1).alias("sequence"), (2 * F.col("turn").cast("bigint")).alias("arrival"))
    twice = c.withColumn("copy", F.explode(F.when(F.col("sequence") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("arrival", F.col("arrival") + F.col("copy")).drop("copy")
    stream.mirror(stream.classify(twice), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("client", "sequence")


# statements that write, as the table their transaction leaves


def _statement(spark: SparkSession, sf_dir: str, text: str):
    source = External(spark, sf_dir, DERIVED)
    source.register("orders")
    return source.read("orders"), binder.bind(parser.parse(text), source.catalog)


_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"


@_operator("dml_insert", f"{_O} UNION ALL VALUES (-1, 5, 'O', NULL), (-2, NULL, 'F', 'x')")
def _(spark, d):
    rows, s = _statement(spark, d, "INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus, o_orderpriority) VALUES (-1, 5, 'O', NULL), (-2, NULL, 'F', 'x')")
    names = [c.name for c in s.columns]
    new = spark.createDataFrame(list(s.rows), rows.select(*names).schema)
    return dml.outcome(rows, dml.inserted(new, s.table), s.table)


@_operator("dml_update", "SELECT o_orderkey, CASE WHEN o_custkey < 100 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_custkey < 100 THEN o_orderstatus ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(spark, d):
    rows, s = _statement(spark, d, "UPDATE orders SET o_custkey = o_custkey + 1, o_orderpriority = o_orderstatus WHERE o_custkey < 100")
    return dml.outcome(rows, dml.updated(rows, s), s.table)


@_operator("dml_delete", f"{_O} WHERE NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0)")
def _(spark, d):
    rows, s = _statement(spark, d, "DELETE FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0")
    return dml.outcome(rows, dml.deleted(rows, s), s.table)


@_operator("dml_duplicate_keys", "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return versions.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@_operator("dml_existing_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3")
def _(spark, d):
    rows, s = _statement(spark, d, "DELETE FROM orders WHERE o_orderkey = 0")
    new = rows.where("o_orderkey % 5 = 3").withColumn("o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_orderkey")).otherwise(-F.col("o_orderkey") - 1))
    return dml.existing_keys(new, rows, s.table).select("o_orderkey")


@_operator("show_tables", "SELECT * FROM (VALUES ('region'), ('nation'), ('orders')) AS t(table_name)")
def _(spark, d):
    source = External(spark, d)
    for name in ("region", "nation", "orders"):
        source.register(name)
    return spark.createDataFrame([(t.name,) for t in source.catalog.tables()], "table_name string").coalesce(1)


@_operator("key_encoding", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, '10' || lpad(hex(CAST(CAST(c_custkey AS HUGEINT) + 9223372036854775808 AS UBIGINT)), 16, '0') || '20' || hex(encode(c_mktsegment)) || '0000' || '30' || CASE WHEN c_custkey % 2 = 0 THEN '01' ELSE '00' END AS key_hex FROM customer")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint"), "c_mktsegment")
    return c.select("c_custkey", F.concat(keys.encode(F.col("c_custkey"), "INT"), keys.encode(F.col("c_mktsegment"), "TEXT"), keys.encode(F.col("c_custkey") % 2 == 0, "BOOL")).alias("key_hex"))


@_operator("session_end_to_end", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(CASE WHEN n_regionkey = 2 THEN n_regionkey + 100 ELSE n_regionkey END AS BIGINT) AS region, n_name AS name FROM nation WHERE n_regionkey <> 3 UNION ALL VALUES (1000, 9, 'Atlantis')")
def _(spark, d):
    from .session import Session, shared_folder
    from .sources.store import Store

    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    with Session(store) as s:
        s.sql("CREATE TABLE nations (id INT PRIMARY KEY, region INT NOT NULL, name TEXT)")
        n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
        s.insert(store.catalog.by_name("nations"), n)
        store.checkpoint()
        s.sql("BEGIN")
        s.sql("INSERT INTO nations (id, region, name) VALUES (1000, 9, 'Atlantis')")
        s.sql("UPDATE nations SET region = region + 100 WHERE region = 2")
        s.sql("DELETE FROM nations WHERE region = 3")
        s.sql("COMMIT")
        return s.sql("SELECT * FROM nations").frame
