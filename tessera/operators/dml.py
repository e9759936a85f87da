"""INSERT, UPDATE and DELETE as pending writes: DataFrames with a row a key and __op."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import binder, compiler
from ..types import SPARK, Table
from . import versions


def inserted(rows: DataFrame, table: Table) -> DataFrame:
    """Rows with the table's columns, by name and type, as puts."""
    return rows.select(*(F.col(f"`{c.name}`").cast(SPARK[c.type]).alias(c.name) for c in table.columns), F.lit("P").alias("__op"))


def existing_keys(rows: DataFrame, visible: DataFrame, table: Table) -> DataFrame:
    """Rows whose key is visible already."""
    key = list(table.primary_key)
    return rows.join(visible.select(*(f"`{k}`" for k in key)), key, "left_semi")


def updated(visible: DataFrame, s: binder.BoundUpdate) -> DataFrame:
    """Every matched row, changed or not; all right-hand sides see the row as it was."""
    new = {c.name: compiler.column(e) for c, e in s.assignments}
    columns = [new[c.name].cast(SPARK[c.type]).alias(c.name) if c.name in new else F.col(f"`{c.name}`") for c in s.table.columns]
    return compiler.restrict(visible, s.table, s.where).select(*columns, F.lit("P").alias("__op"))


def deleted(visible: DataFrame, s: binder.BoundDelete) -> DataFrame:
    """A tombstone for every matched row: its key and nothing else."""
    columns = [F.col(f"`{c.name}`") if c.name in s.table.primary_key else F.lit(None).cast(SPARK[c.type]).alias(c.name) for c in s.table.columns]
    return compiler.restrict(visible, s.table, s.where).select(*columns, F.lit("D").alias("__op"))


def outcome(visible: DataFrame, pending: DataFrame, table: Table) -> DataFrame:
    """The table as its transaction sees it after the writes."""
    return versions.overlay(visible, pending, list(table.primary_key))
