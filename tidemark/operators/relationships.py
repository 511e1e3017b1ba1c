"""Inverse lists of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inverse(edges: DataFrame, target: Column) -> DataFrame:
    """(entity, value): for each target the ascending list of entities whose edge points at it.

    A list is one value of one entity, so it is built in one group; the partial
    aggregation sends each edge once.
    """
    return edges.select(target.alias("_target"), "entity").where("_target is not null").groupBy("_target").agg(F.array_sort(F.collect_list("entity")).alias("value")).select(F.col("_target").alias("entity"), "value")


def digest(edges: DataFrame, target: Column) -> DataFrame:
    """(entity, value): for each target the number of its edges and a digest of the set, by partial aggregation: no group is gathered."""
    each = edges.select(target.alias("_target"), "entity").where("_target is not null")
    n = each.groupBy("_target").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(entity))").alias("digest"))
    return n.select(F.col("_target").alias("entity"), F.struct("n", "digest").alias("value"))


def affected(targets: DataFrame, edges: DataFrame, target: Column) -> DataFrame:
    """The edges that point at any of ``targets`` (column target)."""
    return edges.withColumn("_at", target).join(targets, F.col("_at") == targets["target"], "left_semi").drop("_at")
