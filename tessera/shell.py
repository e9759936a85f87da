"""Command line: statements against a store, and a listing of its log.

    python -m tessera.shell --root DIR sql "SELECT ..."     one statement, its JSON response
    python -m tessera.shell --root DIR sql                  a statement a line from standard input
    python -m tessera.shell --root DIR inspect              markers and checkpoints; exit code 1 if one is malformed
"""

from __future__ import annotations

import argparse
import json
import sys

from .errors import error_to_json
from .session import Session, session
from .sources.store import Marker, Store


def answer(s: Session, text: str) -> dict:
    try:
        return s.sql(text).to_json()
    except Exception as e:
        return error_to_json(e)


def inspect(store_files) -> tuple[list[dict], bool]:
    """A row for each marker and checkpoint; what can't be read is reported and the listing goes on."""
    rows, ok = [], True
    for folder, kind in (("commits", "commit"), ("ckpts", "checkpoint")):
        for name in store_files.names(folder):
            if not name.endswith(".json"):
                continue
            try:
                d = json.loads(store_files.read(f"{folder}/{name}"))
                rows.append({"record": kind, **(vars(Marker(**d)) if kind == "commit" else d)})
            except Exception as e:
                ok = False
                rows.append({"record": kind, "file": name, "malformed": str(e)})
    return rows, ok


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--root", required=True)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("sql").add_argument("statement", nargs="?")
    sub.add_parser("inspect")
    a = p.parse_args(args)
    spark = session(master=a.master)
    if a.what == "inspect":
        from .sources.files import Files

        rows, ok = inspect(Files(spark, a.root))
        for r in rows:
            print(json.dumps(r))
        return 0 if ok else 1
    code = 0
    with Session(Store(spark, a.root)) as s:
        for text in [a.statement] if a.statement else sys.stdin:
            if text.strip():
                out = answer(s, text)
                code = 0 if out["ok"] else 1
                print(json.dumps(out), flush=True)
    return code


if __name__ == "__main__":
    sys.exit(main())
