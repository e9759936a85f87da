"""Order-preserving key bytes as Column expressions: comparing the bytes compares the values.

INT: tag 0x10, then the 64 bits with the sign flipped, big-endian. TEXT: tag 0x20, the UTF-8 bytes with 00 as 00FF,
then 0000. BOOL: tag 0x30, then 00 or 01. A composite key is its parts in a row; a row key is 0x01, the table id, the key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, INT, INT_MIN, TEXT, Table


def encode(value: Column, kind: str) -> Column:
    """Hex text of the key bytes; null keys raise."""
    if kind == INT:
        body = F.concat(F.lit("10"), F.lpad(F.hex(value.bitwiseXOR(F.lit(INT_MIN))), 16, "0"))
    elif kind == TEXT:
        pairs = F.regexp_replace(F.hex(F.encode(value, "UTF-8")), "(..)", "$1 ")
        body = F.concat(F.lit("20"), F.replace(F.regexp_replace(pairs, "00 ", "00FF"), F.lit(" ")), F.lit("0000"))
    elif kind == BOOL:
        body = F.concat(F.lit("30"), F.when(value, "01").otherwise("00"))
    else:
        raise ValueError(f"no key encoding for {kind}")
    return F.when(value.isNull(), F.raise_error(F.lit("a primary key value is NULL"))).otherwise(body)


def primary_key(table: Table) -> Column:
    """Binary key of a row of the table."""
    return F.unhex(F.concat(*(encode(F.col(f"`{k}`"), table.column(k).type) for k in table.primary_key)))


def row_key(table: Table) -> Column:
    return F.concat(F.unhex(F.lit(f"01{table.id:016X}")), primary_key(table))
