"""Tokens of SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import SqlParseError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*")
      | (?P<word>[^\W\d][\w$]*)
      | (?P<op><=>|<>|!=|<=|>=|==|\|\||::|->>|->|[-+*/%=<>(),;.\[\]&|^~!?:@#{}])""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, quoted, word, op, end
    text: str  # words in upper case, strings and quoted names without quotes
    raw: str = ""

    @property
    def name(self) -> str | None:
        """The identifier: unquoted ones fold to lower case."""
        return self.raw.lower() if self.kind == "word" else self.text if self.kind == "quoted" else None


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise SqlParseError(f"unexpected character at {at}: {sql[at]!r}")
        at, kind, raw = m.end(), m.lastgroup, m.group()
        if kind == "space":
            continue
        if kind == "word":
            out.append(Token("word", raw.upper(), raw))
        elif kind in ("string", "quoted"):
            out.append(Token(kind, raw[1:-1].replace(raw[0] * 2, raw[0]), raw))
        else:
            out.append(Token(kind, raw, raw))
    out.append(Token("end", "end of input"))
    return out
