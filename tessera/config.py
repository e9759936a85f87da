"""Settings of a store's server side, checked when they are read."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from .errors import InvalidArgument


@dataclass(frozen=True)
class Config:
    """The defaults."""

    root: str
    most_rows: int = 100_000
    statement_timeout_ms: int = 30_000
    checkpoint_every_commits: int = 100_000

    @classmethod
    def from_toml(cls, text: str) -> Config:
        try:
            found = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise InvalidArgument(f"the configuration is no TOML: {e}") from e
        known = {f.name: f for f in fields(cls)}
        if unknown := sorted(set(found) - set(known)):
            raise InvalidArgument(f"unknown settings: {', '.join(unknown)}")
        if not isinstance(found.get("root"), str) or not found["root"]:
            raise InvalidArgument("root must be a folder")
        for name, value in found.items():
            if name != "root" and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
                raise InvalidArgument(f"{name} must be a positive integer")
        return cls(**found)
