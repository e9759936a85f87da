"""The command state machine and the wire protocol."""

import io
import threading

import pytest

from tessera import errors as E
from tessera.operators.tablet import Command, Outcome, Tablet, replay
from tessera.operators.versions import snapshot
from tessera.server import Client, Server, encode_frame, read_frame
from tessera.sources.store import Store


@pytest.fixture()
def tablet(spark):
    v = spark.createDataFrame([], "k long, v string, __op string, __start_ts long, __commit_ts long, __txn_id long")
    i = spark.createDataFrame([], "k long, v string, __op string, __start_ts long, __txn_id long, __ttl_ms long")
    return Tablet(1, 1, ["k"], v, i, settle=lambda frame: frame.sparkSession.createDataFrame(frame.collect(), frame.schema))


def test_requests_take_effect_once_and_rejections_repeat(tablet, spark):
    p = spark.createDataFrame([(1, "a", "P")], "k long, v string, __op string")
    keys = p.select("k")
    c = lambda n, kind, **a: Command("x", n, kind, 1, 1, a)
    log = [
        c(1, "single_shard_commit", pending=p, start_ts=1, commit_ts=2, txn_id=1), c(1, "single_shard_commit", pending=p, start_ts=1, commit_ts=2, txn_id=1), c(3, "noop"),
        c(2, "prewrite", pending=p, start_ts=1, txn_id=2, ttl_ms=9), c(2, "noop"), c(1, "noop"),
        c(3, "prewrite", pending=p, start_ts=5, txn_id=3, ttl_ms=9), c(4, "resolve_intent", keys=keys, start_ts=5, txn_id=3, decision="committed"),
        c(5, "resolve_intent", keys=keys, start_ts=5, txn_id=3, decision="committed", commit_ts=6), c(6, "rollback", keys=keys, start_ts=5, txn_id=3), Command("x", 7, "noop", 2, 1), c(7, "catalog"),
    ]
    got = replay(tablet, log)
    assert got[:10] == [
        Outcome("applied", 2), Outcome("applied", 2, True), Outcome("gap"), Outcome("rejected", "WRITE_CONFLICT"), Outcome("rejected", "WRITE_CONFLICT", True), Outcome("stale"),
        Outcome("applied"), Outcome("rejected", "INVALID_ARGUMENT"), Outcome("applied", 6), Outcome("rejected", "WRITE_CONFLICT"),
    ]
    assert isinstance(got[10], E.InvalidArgument) and got[11] == Outcome("applied")
    assert snapshot(tablet.versions, ["k"]).collect() == [(1, "a")] and tablet.intents.isEmpty() and tablet.versions.count() == 2


def test_frames():
    stream = io.BytesIO(encode_frame("é") + encode_frame(""))
    assert (read_frame(stream), read_frame(stream), read_frame(stream)) == ("é", "", None)
    for bad in (b"\1\0", b"\5\0\0\0ab", b"\xff\xff\xff\xff", b"\1\0\0\0\xff"):
        with pytest.raises(E.InvalidArgument):
            read_frame(io.BytesIO(bad))


def test_every_value_type_over_the_wire_and_abandoned_writes(spark, tmp_path):
    with Server(Store(spark, str(tmp_path / "s")), connections=2) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        a, b = Client(server.server_address), Client(server.server_address)
        assert a.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, active BOOL NOT NULL, note TEXT)")["result"] == {"type": "created_table", "table_id": 1}
        assert a.sql("INSERT INTO t (id, name, active) VALUES (-9223372036854775808, 'é''x', true)")["stats"]["rows_written"] == 1
        assert b.sql("SELECT * FROM t")["rows"] == [[-(1 << 63), "é'x", True, None]]
        assert b.sql("SELECT nope FROM t") == {"ok": False, "error": {"code": "SCHEMA_MISMATCH", "message": "unknown column nope of table t", "retryable": False}}
        c = Client(server.server_address)
        assert read_frame(c.stream) and True
        c.close()
        b.sql("BEGIN")
        b.sql("DELETE FROM t WHERE active")
        b.close()
        assert len(a.sql("SELECT id FROM t")["rows"]) == 1
        a.close()
        server.shutdown()
