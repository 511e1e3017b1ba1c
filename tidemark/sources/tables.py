"""Components over columns of existing tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """One physical table that several components read: entity is a unique long column."""

    table: DataFrame
    entity: Column
    columns: dict[str, Column]


def from_table(table: DataFrame, entity: str | Column, **columns: str | Column) -> Source:
    """Components as columns of ``table``; rows where a column is null lack that component.

    Components of one source are read by one scan: a query over several of them
    is a projection, not a self-join.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return Source(table, as_column(entity).cast("long"), {k: as_column(c) for k, c in columns.items()})


def kind_entity(kind: int, key: Column) -> Column:
    """An entity of a natural key that differs from those of other kinds."""
    return F.lit(kind * 2**48) + key.cast("long")
