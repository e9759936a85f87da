"""SQL over TCP: frames of a little-endian 32-bit length and UTF-8 text, a JSON response for each statement.

One session a connection; statements of all connections take turns, as the engine has one writer. A connection that
ends with a transaction open loses its writes.
"""

from __future__ import annotations

import json
import socket
import socketserver
import struct
import threading

from .errors import ConnectionLimit, InvalidArgument, StatementTimeout, error_to_json
from .session import Session
from .sources.store import Store

#: Fixed value: the longest frame.
MOST_BYTES = 16 << 20


def encode_frame(text: str) -> bytes:
    body = text.encode("utf-8")
    if len(body) > MOST_BYTES:
        raise InvalidArgument(f"a frame has {MOST_BYTES} bytes at most")
    return struct.pack("<I", len(body)) + body


def read_frame(stream) -> str | None:
    """The next frame's text; None at the end of the stream."""
    head = stream.read(4)
    if not head:
        return None
    if len(head) < 4:
        raise InvalidArgument("the stream ends inside a frame")
    (size,) = struct.unpack("<I", head)
    if size > MOST_BYTES:
        raise InvalidArgument(f"a frame has {MOST_BYTES} bytes at most")
    body = stream.read(size)
    if len(body) < size:
        raise InvalidArgument("the stream ends inside a frame")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise InvalidArgument("a frame is not UTF-8") from e


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, store: Store, address: tuple[str, int] = ("127.0.0.1", 0), connections: int = 100, timeout_ms: int = 30_000):
        self.store, self.turn, self.timeout_s = store, threading.Lock(), timeout_ms / 1000
        self.places = threading.BoundedSemaphore(connections)
        super().__init__(address, _Connection)


class _Connection(socketserver.StreamRequestHandler):
    server: Server

    def handle(self) -> None:
        if not self.server.places.acquire(blocking=False):
            self._answer(error_to_json(ConnectionLimit("too many connections")))
            return
        try:
            with Session(self.server.store) as s:
                while True:
                    try:
                        text = read_frame(self.rfile)
                    except InvalidArgument as e:
                        self._answer(error_to_json(e))
                        return
                    if text is None:
                        return
                    self._answer(self._run(s, text))
        except OSError:
            pass
        finally:
            self.server.places.release()

    def _run(self, s: Session, text: str) -> dict:
        if not self.server.turn.acquire(timeout=self.server.timeout_s):
            return error_to_json(StatementTimeout("the statement waited too long for its turn"))
        try:
            return s.sql(text).to_json()
        except Exception as e:
            return error_to_json(e)
        finally:
            self.server.turn.release()

    def _answer(self, response: dict) -> None:
        self.wfile.write(encode_frame(json.dumps(response)))
        self.wfile.flush()


class Client:
    def __init__(self, address: tuple[str, int]):
        self.socket = socket.create_connection(address)
        self.stream = self.socket.makefile("rwb")

    def sql(self, text: str) -> dict:
        self.stream.write(encode_frame(text))
        self.stream.flush()
        return json.loads(read_frame(self.stream))

    def close(self) -> None:
        self.stream.close()
        self.socket.close()
