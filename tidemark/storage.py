"""Versions of tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A change of at most this share of a table is kept as a layer over it; beyond it the table is written anew.
LAYER_SHARE = 0.25
#: Parts of a table whose rows were put beside each other, at most; beyond it they are written as one.
PARTS = 32
#: Rows up to which the keys of a layer are broadcast; beyond it both sides shuffle.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir.

    Only where it is unset and all runs in one process, as in tests, a temporary
    one is made; executors elsewhere could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Storage:
    """Writes a DataFrame as a Parquet version and reads it again, which cuts its lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
        self.saved = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.saved}"
        self.saved += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
        """``df`` saved, its number of rows ``n``, and these aggregates; all by the one job that writes it."""
        seen = Observation()
        held = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]))
        return held, seen.get

    def count(self, df: DataFrame) -> int:
        """The number of rows, without a shuffle."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        return seen.get["n"]

    def sweep(self, live: set[str]) -> int:
        """Delete the versions of which no file is among ``live``; how many."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        kept = {f.rpartition("/")[0].rstrip("/").rpartition("/")[2] for f in live if self.root.rpartition("/")[2] in f}
        gone = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName() not in kept]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def clear(self) -> None:
        """Delete all versions: nothing read from here can be used afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its known number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Layered:
    """A table of one row a key: a base and, over it, the rows that have changed since, dead ones among them.

    A small change so costs a write of its own size; the base is read with a
    filter on its revisions, which Parquet statistics answer.
    """

    key: str
    base: DataFrame
    n_base: int
    delta: DataFrame | None = None
    n_delta: int = 0
    n: int = 0
    parts: int = 1

    def rows(self) -> DataFrame:
        if self.delta is None:
            return self.base
        return self._rows

    @cached_property
    def _rows(self) -> DataFrame:
        kept = self.base.join(small(self.delta.select(self.key), self.n_delta), self.key, "left_anti")
        return kept.unionByName(self.delta.where("NOT _dead").drop("_dead"))

    def put(self, storage: Storage, change: DataFrame, n_change: int, n: int) -> Layered:
        """With ``change`` (the columns and _dead) over it; ``n`` is the number of rows after it."""
        if self.delta is not None:
            change, seen = storage.counted(self.delta.join(small(change.select(self.key), n_change), self.key, "left_anti").unionByName(change))
            n_change = seen["n"]
        layered = Layered(self.key, self.base, self.n_base, change, n_change, n, self.parts)
        if n_change <= LAYER_SHARE * self.n_base:
            return layered
        return Layered(self.key, storage.save(layered.rows()), n, None, 0, n)
