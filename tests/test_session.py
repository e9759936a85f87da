"""Statements, transactions, durability: from SQL text to rows."""

import random

import pytest

from tessera import errors as E
from tessera.session import Session
from tessera.shell import answer, inspect
from tessera.sources.store import Store


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture()
def users(store):
    s = Session(store)
    s.sql("CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL, score INT, active BOOL)")
    s.sql("INSERT INTO users (id, name, score, active) VALUES (1, 'Ada', 10, true), (2, 'Grace', 20, false), (3, 'Linus', 30, NULL)")
    return s


def rows(s, text):
    return s.sql(text).rows()


def test_filters_and_three_valued_logic(users):
    assert rows(users, "SELECT id FROM users WHERE score > 10 AND active = false") == [(2,)]
    assert rows(users, "SELECT id FROM users WHERE active IS NULL") == [(3,)]
    assert rows(users, "SELECT id FROM users WHERE NOT active") == [(2,)]
    assert rows(users, "SELECT name, id, name FROM users WHERE id = 1") == [("Ada", 1, "Ada")]


def test_rows_come_in_key_order_and_json_has_the_shape(users):
    users.sql("INSERT INTO users (id, name) VALUES (-5, 'neg')")
    out = answer(users, "SELECT id FROM users")
    assert out == {"ok": True, "columns": ["id"], "rows": [[-5], [1], [2], [3]], "stats": {"rows_read": 4, "rows_written": 0}}
    assert answer(users, "DELETE FROM users WHERE id = -5")["result"] == {"type": "mutation", "operation": "delete", "affected_rows": 1}


def test_update_sees_the_original_row_and_counts_unchanged_rows(users):
    assert users.sql("UPDATE users SET score = id, name = name WHERE id = 2 OR id = 3").details["affected_rows"] == 2
    users.sql("UPDATE users SET score = score + id, active = score = 2 WHERE id = 2")
    assert rows(users, "SELECT score, active FROM users WHERE id = 2") == [(4, True)]


def test_insert_is_all_or_nothing(users):
    for text in ("INSERT INTO users (id, name) VALUES (9, 'a'), (9, 'b')", "INSERT INTO users (id, name) VALUES (9, 'a'), (1, 'b')"):
        with pytest.raises(E.ConstraintViolation):
            users.sql(text)
    assert rows(users, "SELECT id FROM users WHERE id = 9") == []


def test_errors_surface_only_for_rows_that_are_read(users):
    for text in ("id <> 1 AND 1 / (id - 1) = 1", "1 / 0 = 1", "id = 2 AND 10 % (id - 2) = 1", "9223372036854775807 + id = 1", "-9223372036854775808 % (id - 2) = 0", "-9223372036854775808 / (id - 2) = 0"):
        with pytest.raises(E.InvalidArgument):
            users.sql(f"SELECT id FROM users WHERE {text}").rows()
    for text in ("id = 99 AND 1 / (id - 99) = 1", "id = 1 AND id = 2 AND 1 / 0 = 1"):
        assert rows(users, f"SELECT id FROM users WHERE {text}") == []
    assert rows(users, "SELECT id FROM users WHERE -7 / 2 = -3 AND -7 % 2 = -1 AND id = 1") == [(1,)]


def test_read_your_writes_rollback_and_statement_errors(users):
    users.sql("BEGIN")
    users.sql("DELETE FROM users WHERE id = 1")
    users.sql("INSERT INTO users (id, name) VALUES (7, 'seven')")
    with pytest.raises(E.ConstraintViolation):
        users.sql("INSERT INTO users (id, name) VALUES (7, 'again')")
    with pytest.raises(E.UnsupportedSql):
        users.sql("CREATE TABLE t (a INT PRIMARY KEY)")
    with pytest.raises(E.InvalidArgument):
        users.sql("BEGIN")
    assert rows(users, "SELECT id FROM users") == [(2,), (3,), (7,)]
    assert rows(Session(users.store), "SELECT id FROM users") == [(1,), (2,), (3,)]
    assert users.sql("ROLLBACK").details["discarded_writes"] == 2
    assert rows(users, "SELECT id FROM users") == [(1,), (2,), (3,)]
    with pytest.raises(E.InvalidArgument):
        users.sql("COMMIT")


def test_first_committer_wins_and_snapshots_hold(users):
    other = Session(users.store)
    users.sql("BEGIN")
    users.sql("UPDATE users SET score = 1 WHERE id = 3")
    other.sql("UPDATE users SET score = 2 WHERE id = 3")
    assert rows(users, "SELECT score FROM users WHERE id = 3") == [(1,)]
    with pytest.raises(E.WriteConflict):
        users.sql("COMMIT")
    assert rows(users, "SELECT score FROM users WHERE id = 3") == [(2,)]


def test_a_row_inserted_and_deleted_still_commits_its_tombstone(users):
    users.sql("BEGIN")
    users.sql("INSERT INTO users (id, name) VALUES (8, 'x')")
    users.sql("DELETE FROM users WHERE id = 8")
    assert users.sql("COMMIT").details["committed_writes"] == 1
    users.sql("BEGIN")
    assert users.sql("COMMIT").details == {"transaction_id": users.store.last_txn, "commit_timestamp": None, "committed_writes": 0}


def test_one_table_a_commit(users):
    users.sql("CREATE TABLE t (a INT PRIMARY KEY)")
    users.sql("BEGIN")
    users.sql("INSERT INTO t (a) VALUES (1)")
    users.sql("INSERT INTO users (id, name) VALUES (5, 'x')")
    with pytest.raises(E.UnsupportedSql):
        users.sql("COMMIT")
    assert rows(users, "SELECT a FROM t") == []
    assert rows(users, "SHOW TABLES") == [("users",), ("t",)]


def test_row_cap(users):
    small = Session(users.store, most_rows=2)
    with pytest.raises(E.InvalidArgument):
        small.sql("SELECT id FROM users")
    with pytest.raises(E.InvalidArgument):
        small.sql("UPDATE users SET score = 1 WHERE id > 0")
    assert len(rows(small, "SELECT id FROM users WHERE id > 1")) == 2


def test_reopening_recovers_everything(users, spark):
    users.sql("UPDATE users SET score = 99 WHERE id = 1")
    ts = users.store.checkpoint()
    users.sql("DELETE FROM users WHERE id = 2")
    again = Store(spark, users.store.root)
    assert (again.last_ts, again.last_txn, again.catalog.next_id) == (users.store.last_ts, users.store.last_txn, 2)
    assert rows(Session(again), "SELECT id, score FROM users") == [(1, 99), (3, 30)]
    table = again.catalog.by_name("users")
    assert sorted(again.snapshot(table, ts).select("id").collect()) == [(1,), (2,), (3,)]
    again.verify_checkpoint(ts)
    again.snapshot(table, ts).limit(2).write.mode("append").parquet(f"{again.root}/t1/ckpt/{ts:020d}")
    with pytest.raises(E.CorruptData):
        again.verify_checkpoint(ts)
    assert set(again.verify(table).values()) == {0}
    listing, ok = inspect(again.files)
    assert ok and [r["record"] for r in listing] == ["commit"] * 3 + ["checkpoint"]


def test_data_without_a_marker_is_no_commit(users, spark):
    store, table = users.store, users.store.catalog.by_name("users")
    real = store.files.create
    store.files.create = lambda name, text: (_ for _ in ()).throw(OSError("lost")) if name.startswith("commits/") else real(name, text)
    with pytest.raises(E.CommitOutcomeUnknown):
        users.sql("INSERT INTO users (id, name) VALUES (50, 'ghost')")
    with pytest.raises(E.RecoveryRequired):
        users.sql("SELECT id FROM users")
    assert store.snapshot(table).where("id = 50").isEmpty()
    assert rows(Session(Store(spark, store.root)), "SELECT id FROM users WHERE id = 50") == []


def test_two_processes_on_one_folder_serialise(users, spark):
    a, b = Session(users.store), Session(Store(spark, users.store.root))
    b.sql("BEGIN")
    b.sql("INSERT INTO users (id, name) VALUES (61, 'b')")
    a.sql("INSERT INTO users (id, name) VALUES (60, 'a')")
    assert rows(b, "SELECT id FROM users WHERE id >= 60") == [(61,)]
    b.sql("COMMIT")
    b.sql("BEGIN")
    b.sql("UPDATE users SET score = 1 WHERE id = 60")
    a.sql("UPDATE users SET score = 2 WHERE id = 60")
    with pytest.raises(E.WriteConflict):
        b.sql("COMMIT")
    assert rows(Session(Store(spark, users.store.root)), "SELECT id FROM users WHERE id >= 60") == [(60,), (61,)]


def test_corrupt_log_is_refused(users, spark):
    store = users.store
    name = store.files.names("commits")[-1]
    assert store.files.create("commits/00000000000000000002.json", store.files.read(f"commits/{name}"))
    with pytest.raises(E.CorruptData):
        Store(spark, store.root)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_statements_agree_with_a_dictionary(store, seed):
    rng, s, model = random.Random(seed), Session(store), {}
    s.sql("CREATE TABLE t (a INT, b TEXT, c INT, PRIMARY KEY (a, b))")
    saved = None
    for _ in range(9):
        a, b, c = rng.randrange(4), rng.choice("xyz"), rng.randrange(-3, 4)
        kind = rng.choice(["insert", "insert", "update", "delete", "begin", "end", "checkpoint"])
        if kind == "insert":
            try:
                s.sql(f"INSERT INTO t (a, b, c) VALUES ({a}, '{b}', {c})")
                assert (a, b) not in model
                model[a, b] = c
            except E.ConstraintViolation:
                assert (a, b) in model
        elif kind == "update":
            s.sql(f"UPDATE t SET c = c * 2 - a WHERE b = '{b}' OR c < {c}")
            model = {k: v * 2 - k[0] if k[1] == b or v < c else v for k, v in model.items()}
        elif kind == "delete":
            s.sql(f"DELETE FROM t WHERE a = {a} AND c >= {c}")
            model = {k: v for k, v in model.items() if not (k[0] == a and v >= c)}
        elif kind == "begin" and s.open is None:
            s.sql("BEGIN")
            saved = dict(model)
        elif kind == "end" and s.open:
            undo = rng.random() < 0.5
            s.sql("ROLLBACK" if undo else "COMMIT")
            model = saved if undo else model
        elif kind == "checkpoint" and s.open is None:
            store.checkpoint()
    assert rows(s, "SELECT a, b, c FROM t") == [(*k, v) for k, v in sorted(model.items())]
