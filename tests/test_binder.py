"""What the language accepts and refuses, one rule a case; no Spark."""

import pytest

from tessera import errors as E
from tessera.catalog import Catalog
from tessera.plans import binder, compiler, parser
from tessera.types import BOOL, INT, TEXT, Column, Table

USERS = Table(1, "users", (Column(1, "id", INT, False), Column(2, "name", TEXT, True), Column(3, "active", BOOL, True), Column(4, "score", INT, False)), ("id",))
PAIRS = Table(2, "memberships", (Column(1, "user_id", INT, False), Column(2, "group_id", INT, False), Column(3, "role", TEXT, False)), ("user_id", "group_id"))


@pytest.fixture()
def catalog():
    c = Catalog()
    c.install(USERS)
    c.install(PAIRS)
    return c


def bound(text, catalog):
    return binder.bind(parser.parse(text), catalog)


REFUSED = [
    (E.InvalidArgument, ["", " ; ", "SELECT id FROM users; SELECT id FROM users"]),
    (E.SqlParseError, ["SELEC id FROM users", "SELECT FROM users", "SELECT id FROM", "SELECT id FROM users WHERE", "INSERT INTO users (id VALUES (1)", "SELECT id FROM users WHERE id = = 1", "SELECT 'open FROM users"]),
    (E.UnsupportedSql, [
        "DROP TABLE users", "ALTER TABLE users ADD x INT", "TRUNCATE users", "EXPLAIN SELECT id FROM users", "CREATE VIEW v AS SELECT id FROM users", "CREATE INDEX i ON users (id)",
        "WITH x AS (SELECT id FROM users) SELECT id FROM x", "VALUES (1)", "MERGE INTO users USING u ON 1 = 1", "SET x = 1",
        "BEGIN ISOLATION LEVEL SERIALIZABLE", "START TRANSACTION READ ONLY", "COMMIT AND CHAIN", "ROLLBACK AND CHAIN", "ROLLBACK TO SAVEPOINT x",
        "CREATE TABLE IF NOT EXISTS t (a INT PRIMARY KEY)", "CREATE TABLE t AS SELECT id FROM users", "CREATE TABLE t (a BIGINT PRIMARY KEY)", "CREATE TABLE t (a VARCHAR(3) PRIMARY KEY)", "CREATE TABLE t (a INT PRIMARY KEY, b DECIMAL)",
        "CREATE TABLE t (a INT UNIQUE)", "CREATE TABLE t (a INT PRIMARY KEY, b INT DEFAULT 1)", "CREATE TABLE t (a INT PRIMARY KEY, CHECK (a > 1))", "CREATE TABLE t (a INT, CONSTRAINT k PRIMARY KEY (a))", "CREATE TABLE t (a INT PRIMARY KEY) USING parquet", "CREATE TEMPORARY TABLE t (a INT PRIMARY KEY)",
        "INSERT INTO users VALUES (1, 'a', true, 1)", "INSERT INTO users (id, score) SELECT id, score FROM users", "INSERT INTO users (id, score) VALUES (1 + 1, 1)", "INSERT INTO users (id, score) VALUES (1, 1) RETURNING id", "INSERT INTO users (id, score) VALUES (1, 1) ON CONFLICT DO NOTHING", "INSERT OR REPLACE INTO users (id, score) VALUES (1, 1)", "INSERT INTO users (id, score) VALUES ROW(1, 1)",
        "SELECT 1", "SELECT id FROM users u", "SELECT id FROM users AS u", "SELECT id FROM users, memberships", "SELECT id FROM users JOIN memberships ON id = user_id", "SELECT users.id FROM users", "SELECT id FROM db.users", "SELECT id + 1 FROM users", "SELECT id AS x FROM users", "SELECT 1 FROM users", "SELECT DISTINCT id FROM users",
        "SELECT id FROM users GROUP BY id", "SELECT id FROM users HAVING id > 1", "SELECT id FROM users ORDER BY id", "SELECT id FROM users LIMIT 1", "SELECT id FROM users OFFSET 1", "SELECT id FROM users UNION SELECT id FROM users", "SELECT id FROM users FOR UPDATE", "SELECT count(*) FROM users", "SELECT id FROM (SELECT id FROM users)", "SELECT TOP 1 id FROM users",
        "SELECT id FROM users WHERE id IN (1, 2)", "SELECT id FROM users WHERE id BETWEEN 1 AND 2", "SELECT id FROM users WHERE name LIKE 'a'", "SELECT id FROM users WHERE abs(id) = 1", "SELECT id FROM users WHERE CASE WHEN active THEN true END", "SELECT id FROM users WHERE CAST(id AS TEXT) = 'a'", "SELECT id FROM users WHERE EXISTS (SELECT id FROM users)", "SELECT id FROM users WHERE id = (SELECT id FROM users)", "SELECT id FROM users WHERE name || 'a' = 'b'", "SELECT id FROM users WHERE active IS TRUE", "SELECT id FROM users WHERE id & 1 = 1", "SELECT id FROM users WHERE id::TEXT = 'a'",
        "SELECT id FROM users WHERE name = NULL", "SELECT id FROM users WHERE NULL < 1", "UPDATE users SET score = 1", "UPDATE users SET score = 1 FROM memberships WHERE id = 1", "UPDATE users SET (score, name) = (1, 'a') WHERE id = 1", "DELETE FROM users", "DELETE users WHERE id = 1", "DELETE FROM users USING memberships WHERE id = 1", "UPDATE users SET score = 1 WHERE id = 1 RETURNING id", "DELETE FROM users WHERE id = 1 LIMIT 1",
        "SHOW TABLES LIKE 'a'", "SHOW FULL TABLES", "SHOW DATABASES",
    ]),
    (E.ConstraintViolation, [
        "CREATE TABLE users (a INT PRIMARY KEY)", "CREATE TABLE t (a INT)", "CREATE TABLE t (a INT PRIMARY KEY, a TEXT)", "CREATE TABLE t (a INT NULL PRIMARY KEY)", "CREATE TABLE t (a INT NULL NOT NULL PRIMARY KEY)", "CREATE TABLE t (a INT PRIMARY KEY, b INT, PRIMARY KEY (b))", "CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)", "CREATE TABLE t (a INT, PRIMARY KEY (a, a))", "CREATE TABLE t ()",
        "INSERT INTO users (id, id, score) VALUES (1, 1, 1)", "INSERT INTO users (score) VALUES (1)", "INSERT INTO users (id) VALUES (1)", "INSERT INTO users (id, score) VALUES (1)", "INSERT INTO users (id, score) VALUES (1, NULL)", "INSERT INTO users (id, score) VALUES (NULL, 1)",
        "UPDATE users SET score = 1, score = 2 WHERE id = 1", "UPDATE users SET id = 2 WHERE id = 1", "UPDATE users SET score = NULL WHERE id = 1",
    ]),
    (E.SchemaMismatch, [
        "CREATE TABLE t (a INT, PRIMARY KEY (b))", "INSERT INTO nobody (id) VALUES (1)", "INSERT INTO users (id, score, x) VALUES (1, 1, 1)", "INSERT INTO users (id, score) VALUES ('a', 1)", "INSERT INTO users (id, score) VALUES (1.5, 1)", "INSERT INTO users (id, score) VALUES (9223372036854775808, 1)",
        "SELECT id FROM nobody", "SELECT x FROM users", 'SELECT "ID" FROM users', "SELECT id FROM users WHERE id", "SELECT id FROM users WHERE NULL", "SELECT id FROM users WHERE name = 1", "SELECT id FROM users WHERE active > false", "SELECT id FROM users WHERE name + 1 = 2", "SELECT id FROM users WHERE active AND NULL", "SELECT id FROM users WHERE NOT id", "SELECT id FROM users WHERE -name = 1", "SELECT id FROM users WHERE id = 1e3", "SELECT id FROM users WHERE -(9223372036854775808) = id", "SELECT id FROM users WHERE id + NULL = 1", "UPDATE users SET name = 1 WHERE id = 1", "UPDATE users SET x = 1 WHERE id = 1", "UPDATE users SET score = 1 WHERE id",
    ]),
]


@pytest.mark.parametrize(("kind", "text"), [(kind, text) for kind, texts in REFUSED for text in texts])
def test_refuses(kind, text, catalog):
    with pytest.raises(E.EngineError) as e:
        bound(text, catalog)
    assert type(e.value) is kind, f"{text}: {e.value!r}"


def test_maybe_null_into_not_null_is_refused_statically(catalog):
    t = Table(3, "t", (Column(1, "id", INT, False), Column(2, "a", INT, True), Column(3, "b", INT, False)), ("id",))
    catalog.install(t)
    with pytest.raises(E.ConstraintViolation):
        bound("UPDATE t SET b = a + 1 WHERE id = 1", catalog)
    assert bound("UPDATE t SET b = b + 1, a = NULL WHERE id = 1", catalog).assignments


def test_wildcard_expands_in_catalog_order_and_mixes(catalog):
    assert [c.name for c in bound("SELECT *, id FROM users", catalog).columns] == ["id", "name", "active", "score", "id"]


def test_create_assigns_ids_and_makes_keys_not_null(catalog):
    t = bound('CREATE TABLE t (B INT(11), "A" TEXT NOT NULL, c BOOLEAN, PRIMARY KEY (c, b))', catalog).table
    assert [(c.id, c.name, c.type, c.nullable) for c in t.columns] == [(1, "b", INT, False), (2, "A", TEXT, False), (3, "c", BOOL, False)]
    assert t.primary_key == ("c", "b")


def test_smallest_integer_and_precedence(catalog):
    assert bound("SELECT id FROM users WHERE id = -9223372036854775808", catalog)
    e = bound("SELECT id FROM users WHERE NOT id = 1 AND active OR score - 1 - 2 > 0", catalog).where
    assert e.op == "OR" and e.args[0].op == "AND" and e.args[0].args[0].op == "not" and e.args[1].args[0].args[0].op == "-"
    assert bound("SELECT id FROM users WHERE id = 1 IS NULL", catalog).where.op == "is null"


def test_access_paths(catalog):
    path = lambda text: compiler.access(PAIRS, bound(f"SELECT role FROM memberships WHERE {text}", catalog).where).kind
    assert path("group_id = 20 AND 1 = user_id AND role = 'x'") == "point"
    assert path("group_id = 20") == path("group_id = 20 OR user_id = 1") == path("NOT (group_id = 20 AND user_id = 1)") == "scan"
    assert path("group_id = 20 AND group_id = 21") == "empty"


def test_error_responses_redact_the_inside():
    assert E.error_to_json(E.WriteConflict("x")) == {"ok": False, "error": {"code": "WRITE_CONFLICT", "message": "x", "retryable": True}}
    assert E.error_to_json(E.CorruptData("secret"))["error"] == E.error_to_json(KeyError("secret"))["error"]
    assert "secret" not in str(E.error_to_json(E.RecoveryRequired("secret")))


def test_catalog_installs_once_and_never_reuses_ids(catalog):
    catalog.install(USERS)
    with pytest.raises(E.ConstraintViolation):
        catalog.install(Table(1, "users", USERS.columns[:1], ("id",)))
    catalog.raise_floor(10)
    made = catalog.prepare(Table(0, "t", USERS.columns, ("id",)))
    assert made.id == 10 and catalog.by_name("t") is None
    catalog.publish(made)
    assert [t.name for t in catalog.tables()] == ["users", "memberships", "t"] and Table.from_json(made.to_json()) == made


def test_configuration_is_strict():
    from tessera.config import Config

    assert Config.from_toml('root = "/x"').most_rows == 100_000
    for bad in ("root = 1", 'root = "/x"\nport = 1', 'root = "/x"\nmost_rows = 0', "root"):
        with pytest.raises(E.InvalidArgument):
            Config.from_toml(bad)
