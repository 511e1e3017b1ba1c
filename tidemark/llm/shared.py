"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

#: A key is heavy if it has more than one in HEAVY_SHARE of all rows; so at most HEAVY_SHARE keys are.
HEAVY_SHARE = 1000
#: Parts that the rows of a heavy key are dealt into.
SALTS = 128


#: Folders of tables made since ``scratch`` began, innermost last.
_scratch: list[list[tuple[SparkSession, str]]] = []


class Tables:
    """Intermediate tables in the shared folder; lineage is cut there, so a lost executor costs one stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if _scratch:
            _scratch[-1].append((spark, self.root))

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path) if not partition_by else self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` written; what it was made from is deleted."""
        found = self.save(df, "result")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(root):
            if f.getPath().getName() != "result":
                fs.delete(f.getPath(), True)
        return found


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Tables that operators make in the block are deleted after it; what is wanted of them has been written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, root in _scratch.pop():
            delete(spark, root)


def heavy_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join left to right, which has one row a key, without sending a hot key to one task; left is read once.

    ``weight`` is right's column with the number of left's rows of that key and
    ``total`` is their sum.  Keys over ``total / HEAVY_SHARE`` are at most
    HEAVY_SHARE, whatever the data, so their list is broadcast: rows of these
    keys are salted by a hash of the row and right's rows repeated for each salt.
    """
    limit = max(1, total // HEAVY_SHARE)
    heavy = F.broadcast(right.where(F.col(weight) > limit).select(F.col(key).alias("_heavy")))
    salt = F.when(F.col("_heavy").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(0).cast("int")
    salted = left.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_salt", salt).drop("_heavy")
    repeated = right.withColumn("_salt", F.explode(F.when(F.col(weight) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(weight)
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def crc_mod(column: str, by: int) -> Column:
    """crc32 of a column as text, modulo ``by``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that others, whatever their names, play no part."""
    return df.select(*[df[n] for n in names])


def map_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``make`` to bounded Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = make(batch.slice(at, 512))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads them (the SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes along the links a-b."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
        if np.array_equal(before, label):
            break
    return label


def components(spark: SparkSession, links: DataFrame, tables: Tables) -> DataFrame:
    """Connected components of links (a, b: long): one row per linked node, (node, root), root the least node.

    Alternates large-star and small-star steps, each written to the shared
    folder, until nothing changes.  Hubs are joined as heavy keys.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    step, seen, last = 0, None, None
    while True:
        edges = tables.save(edges, f"edges{step}")
        if last:
            tables.drop(last)
        last = f"edges{step}"
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now.n == 0 or (now.n, now.x) == seen:
            break
        seen = (now.n, now.x)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_w")).withColumn("m", F.least("u", "m"))
        large = heavy_join(both, least, "u", "_w", 2 * now.n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.save(large, f"large{step}")
        count = large.count()
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_w"))
        hung = heavy_join(large, small, "u", "_w", count).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        if step:
            tables.drop(f"large{step - 1}")
        step += 1
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
