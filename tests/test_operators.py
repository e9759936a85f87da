"""Version, intent, key and command operators on small tables, and every registered query at the smallest scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import errors as E
from tessera.functions import keys, scalar
from tessera.operators import commands, versions
from tessera.queries import QUERIES, SQL, event_versions, pending_writes

SF = "/root/testdata/sf0.001"
LOG = "k long, v string, __op string, __start_ts long, __commit_ts long, __txn_id long"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, spark, duck):
    found = QUERIES[name](spark, SF)
    wanted = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    ours = sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect())))
    theirs = sorted(map(repr, wanted.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
    assert ours == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def test_rollbacks_are_skipped_and_tombstones_hide(spark):
    v = log(spark, (1, "a", "P", 1, 2, 1), (1, None, "R", 5, 5, 2), (2, "b", "P", 1, 2, 1), (2, None, "D", 3, 4, 3))
    assert versions.snapshot(v, ["k"]).collect() == [(1, "a")]
    assert sorted(versions.snapshot(v, ["k"], 3).collect()) == [(1, "a"), (2, "b")]
    assert versions.snapshot(v, ["k"], 1).collect() == []


def test_commit_is_idempotent_and_partial_commits_are_corrupt(spark):
    v = log(spark, (1, "a", "P", 1, 2, 1))
    p = spark.createDataFrame([(1, "b", "P"), (2, "c", "P")], "k long, v string, __op string")
    once = versions.apply_commit(v, p, ["k"], 3, 4, 9)
    assert versions.apply_commit(once, p, ["k"], 3, 4, 9).count() == once.count() == 3
    with pytest.raises(E.CorruptData):
        versions.apply_commit(once.where("k <> 2"), p, ["k"], 3, 4, 9)
    with pytest.raises(E.WriteConflict):
        versions.apply_commit(once, p, ["k"], 1, 8, 10)


def test_a_replay_with_another_write_is_corrupt(spark):
    v = log(spark, (1, "old", "P", 3, 4, 9), (2, None, "D", 3, 4, 9), (3, None, "P", 3, 4, 9))
    same = [(1, "old", "P"), (2, "ignored", "D"), (3, None, "P")]
    make = lambda rows: spark.createDataFrame(rows, "k long, v string, __op string")
    assert versions.apply_commit(v, make(same), ["k"], 3, 4, 9).count() == 3
    for k, other in enumerate([(1, "NEW", "P"), (2, "x", "P"), (3, "x", "P")]):
        with pytest.raises(E.CorruptData):
            versions.apply_commit(v, make([*same[:k], other, *same[k + 1 :]]), ["k"], 3, 4, 9)
    with pytest.raises(E.CorruptData):  # another start holds the commit timestamp
        versions.apply_commit(v, make(same), ["k"], 2, 4, 8)
    with pytest.raises(E.CorruptData):  # the same transaction, another commit timestamp and row
        versions.apply_commit(v, make([(1, "NEW", "P")]), ["k"], 3, 6, 9)


def test_own_locks_must_agree_and_go_with_the_commit(spark):
    v = log(spark, (9, "z", "P", 1, 2, 1))
    intents = "k long, v string, __op string, __start_ts long, __txn_id long, __ttl_ms long"
    p = spark.createDataFrame([(1, "b", "P"), (2, None, "D")], "k long, v string, __op string")
    i = versions.prewrite(spark.createDataFrame([(5, "other", "P", 4, 6, 100)], intents), v, p, ["k"], 5, 7, 100)
    for other in ([(1, "c", "P"), (2, None, "D")], [(1, "b", "P"), (2, "x", "P")], [(1, None, "D"), (2, None, "D")]):
        changed = spark.createDataFrame(other, p.schema)
        with pytest.raises(E.CorruptData):
            versions.prewrite(i, v, changed, ["k"], 5, 7, 100)
        with pytest.raises(E.CorruptData):
            versions.apply_commit(v, changed, ["k"], 5, 6, 7, i)
    with pytest.raises(E.WriteConflict):  # the same transaction id with another start is another lock
        versions.apply_commit(v, p, ["k"], 3, 6, 7, i)
    assert versions.apply_commit(v, p, ["k"], 5, 6, 7, i).count() == 3
    assert [r.k for r in versions.released(i, p, ["k"], 5, 7).collect()] == [5]
    assert sorted(r.k for r in versions.released(i, p, ["k"], 6, 7).collect()) == [1, 2, 5]


def test_intents_from_prewrite_to_commit_and_rollback(spark):
    v = log(spark, (1, "a", "P", 1, 2, 1))
    i = spark.createDataFrame([], "k long, v string, __op string, __start_ts long, __txn_id long, __ttl_ms long")
    p = spark.createDataFrame([(1, "b", "P"), (2, None, "D")], "k long, v string, __op string")
    i = versions.prewrite(i, v, p, ["k"], 5, 7, 100)
    assert i.count() == versions.prewrite(i, v, p, ["k"], 5, 7, 100).count() == 2
    with pytest.raises(E.WriteConflict):
        versions.prewrite(i, v, p, ["k"], 6, 8, 100)
    assert [r.k for r in versions.locked(v, i, ["k"], 5).collect()] == [1] and versions.locked(v, i, ["k"], 4).isEmpty()
    left, done = versions.commit_intents(i, v, p.where("k = 1"), ["k"], 5, 6, 7)
    assert left.count() == 1 and versions.snapshot(done, ["k"]).collect() == [(1, "b")]
    assert versions.commit_intents(left, done, p.where("k = 1"), ["k"], 5, 6, 7)[1].count() == done.count()
    left, done = versions.rollback_intents(left, done, p.where("k = 2"), ["k"], 5, 7)
    assert left.isEmpty() and done.where("__op = 'R'").count() == 1
    with pytest.raises(E.WriteConflict):
        versions.commit_intents(left, done, p.where("k = 2"), ["k"], 5, 6, 7)
    with pytest.raises(E.WriteConflict):
        versions.rollback_intents(left, done, p.where("k = 1"), ["k"], 5, 7)
    with pytest.raises(E.WriteConflict):  # the rolled-back transaction can't come back
        versions.prewrite(left, done, p.where("k = 2"), ["k"], 5, 7, 100)


def test_key_bytes_sort_like_values(spark):
    ints = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    d = spark.createDataFrame([(x,) for x in ints], "x long").select("x", F.unhex(keys.encode(F.col("x"), "INT")).alias("b"))
    assert [r.x for r in sorted(d.collect(), key=lambda r: bytes(r.b))] == ints
    texts = ["", "\0", "\0a", "a", "a\0", "a\0b", "aa", "é", "z"]
    d = spark.createDataFrame([(x,) for x in texts], "x string").select("x", F.unhex(keys.encode(F.col("x"), "TEXT")).alias("b"))
    assert [r.x for r in sorted(d.collect(), key=lambda r: bytes(r.b))] == sorted(texts, key=str.encode)
    assert {r.x: bytes(r.b) for r in d.collect()}["a\0b"] == b"\x20a\0\xffb\0\0"


def test_strict_logic_has_the_three_valued_tables(spark):
    values = [True, False, None]
    d = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    r = d.select(scalar.strict_and(F.col("a"), F.col("b")).eqNullSafe(F.col("a") & F.col("b")).alias("x"), scalar.strict_or(F.col("a"), F.col("b")).eqNullSafe(F.col("a") | F.col("b")).alias("y")).collect()
    assert all(x and y for x, y in r)


def test_commands_take_effect_once(spark):
    c = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 3, 2), ("a", 2, 3), ("a", 1, 4), ("a", 3, 5), ("b", 2, 0), ("b", 1, 1), ("b", None, 2)], "client string, sequence long, arrival long")
    found = {(r.client, r.arrival): r.verdict for r in commands.classify(c).collect()}
    assert found == {("a", 0): "applied", ("a", 1): "duplicate", ("a", 2): "gap", ("a", 3): "applied", ("a", 4): "stale", ("a", 5): "applied", ("b", 0): "gap", ("b", 1): "applied", ("b", 2): "gap"}


def test_log_view_truncates_after_a_conflicting_term(spark):
    a = spark.createDataFrame([("r", 1, 1, 0), ("r", 2, 1, 1), ("r", 3, 1, 2), ("r", 2, 2, 3), ("r", 2, 2, 4)], "replica string, index long, term long, arrival long")
    assert sorted((r["index"], r["term"]) for r in commands.surviving_entries(a).collect()) == [(1, 1), (2, 2)]


def test_filters_reach_the_scan(spark):
    plan = QUERIES["flagship_orders"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), IsNotNull(o_orderstatus), LessThan(o_custkey,100), EqualTo(o_orderstatus,O)]" in plan
    assert "o_totalprice" not in plan and "Exchange" not in plan
    assert "LocalTableScan <empty>" in QUERIES["empty_contradiction"](spark, SF)._jdf.queryExecution().optimizedPlan().toString() or "LocalRelation <empty>" in QUERIES["empty_contradiction"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_commit_keeps_its_place_in_a_longer_log(spark, tmp_path):
    users = {449_998: 7, 449_999: 8, 450_000: 7, 450_001: 8, 600_000: 14, 5_999_999: 3, None: 7}
    rows = [(e, u, t) for t in ("click", "error", "view", None) for e, u in users.items()] + [(1, None, "click")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        wanted = con.sql(SQL["mvcc_apply_commit"]).fetchall()
    found = QUERIES["mvcc_apply_commit"](spark, str(tmp_path)).select("user_id", "__op", "__start_ts", "__commit_ts", "__txn_id").collect()
    assert len(found) == len(rows) + 3 and sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    with pytest.raises(E.WriteConflict):  # the operator still refuses a commit that the log has overtaken
        versions.apply_commit(event_versions(spark, str(tmp_path)).where("user_id = 14"), pending_writes(spark, str(tmp_path)), ["user_id"], 900_001, 900_002, 77)
