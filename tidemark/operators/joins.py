"""Joins of rule parameters.

Every parameter is a DataFrame whose columns carry its own prefix.  Parameters
join in their order: an equality binds to the one earlier or later parameter
that reads the key, a membership binds an entity to a list of entities, an
optional parameter joins outer, and parameters that nothing binds form a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair: only where a rule asks for it, as for a gate of one row."""
    return left.crossJoin(right)


def equality(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], outer: bool = False) -> DataFrame:
    """Rows whose keys are equal, on values; rows without a key never pair."""
    return left.join(right, F.expr(" AND ".join(f"`{a}` = `{b}`" for a, b in pairs)), "left" if outer else "inner")


def membership(left: DataFrame, right: DataFrame, members: str, entity: str) -> DataFrame:
    """Pairs of a list's row and each of its members: the list is exploded and left behind, so the join stays an equality and no pair carries a list."""
    each = left.withColumn("_member", F.explode(F.col(f"`{members}`"))).drop(members)
    return each.join(right, F.col("_member") == F.col(f"`{entity}`")).drop("_member")


def along_edges(left: DataFrame, edges: DataFrame, right: DataFrame, target: str, entity: str) -> DataFrame:
    """Pairs of an edge's target and source, by the edges themselves: (at, member).  No list of members is ever built."""
    each = left.join(edges, F.col(f"`{target}`") == F.col("_at")).drop("_at")
    return each.join(right, F.col("_member") == F.col(f"`{entity}`")).drop("_member")


def greatest_of(columns: list[str]) -> Column:
    """The greatest, nulls aside; -1 if there is none."""
    found = [f"coalesce(`{c}`, -1)" for c in columns]
    return F.expr(f"greatest({', '.join(found)})" if len(found) > 1 else found[0] if found else "-1")
