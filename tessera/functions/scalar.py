"""Column expressions with the engine's semantics. ANSI mode must be on: overflow and division by zero raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import INT_MIN


def divide(a: Column, b: Column) -> Column:
    """Truncating integer division; NULL operands come before the test for zero."""
    return F.call_function("div", a, b)


def remainder(a: Column, b: Column) -> Column:
    """Sign of the dividend; the smallest integer by -1 overflows, as its quotient does."""
    overflow = F.raise_error(F.lit("integer remainder overflow")).cast("bigint")
    return F.when((a == F.lit(INT_MIN)) & (b == F.lit(-1).cast("bigint")), overflow).otherwise(a % b)


def strict_and(*args: Column) -> Column:
    """Three-valued AND that evaluates all operands, so that an error in any of them surfaces."""
    return ~F.array_contains(F.array(*args), False)


def strict_or(*args: Column) -> Column:
    return F.array_contains(F.array(*args), True)


def only_for(candidate: Column, predicate: Column) -> Column:
    """predicate, evaluated for candidates alone and not before there is a row."""
    return F.when(candidate, predicate).otherwise(F.lit(False))


def all_of(args: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, args)
