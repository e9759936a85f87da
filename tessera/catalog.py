"""Table definitions by name and id. Definitions never change; ids rise and are not used again."""

from __future__ import annotations

from .errors import ConstraintViolation
from .types import Table


class Catalog:
    def __init__(self, next_id: int = 1):
        self._by_id: dict[int, Table] = {}
        self._by_name: dict[str, Table] = {}
        self._next = next_id

    def by_name(self, name: str) -> Table | None:
        return self._by_name.get(name)

    def by_id(self, id: int) -> Table | None:
        return self._by_id.get(id)

    def tables(self) -> list[Table]:
        """In the order of their ids."""
        return [self._by_id[k] for k in sorted(self._by_id)]

    @property
    def next_id(self) -> int:
        return self._next

    def prepare(self, table: Table) -> Table:
        """The definition as it would be published: checked, with the next id. Changes nothing."""
        if table.name in self._by_name:
            raise ConstraintViolation(f"table already exists: {table.name}")
        return table.with_id(self._next).validate()

    def publish(self, table: Table) -> None:
        self.install(table)

    def install(self, table: Table) -> None:
        """A definition from elsewhere, under its own id. The same one again changes nothing; another is refused."""
        table.validate()
        if table.id < 1:
            raise ConstraintViolation("table ids start at 1")
        known = self._by_id.get(table.id)
        if known == table:
            return
        if known is not None or table.name in self._by_name:
            raise ConstraintViolation(f"another table has the id {table.id} or the name {table.name}")
        self._by_id[table.id] = self._by_name[table.name] = table
        self._next = max(self._next, table.id + 1)

    def declare(self, table: Table) -> None:
        """A relation without a key: it can be read by name and is no managed table."""
        self._by_name[table.name] = table

    def raise_floor(self, next_id: int) -> None:
        self._next = max(self._next, next_id)
