"""Facts from a stream: each micro-batch is one bundle insert, then the store settles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def ingest(engine: Engine, stream: DataFrame, entity: str | Column, checkpoint: str, settle: bool = True, after: Callable[[int], None] | None = None, **columns: str | Column) -> StreamingQuery:
    """Start a query that inserts each micro-batch's columns as components; it ends when all that is there has been read.

    Values are written by entity, so a batch that is delivered again changes nothing.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c

    def work(batch: DataFrame, number: int) -> None:
        held = engine.storage.save(batch.select(as_column(entity).cast("long").alias("_entity"), *[as_column(c).alias(f"_{n}") for n, c in columns.items()]))
        engine.insert(**{n: held.select(F.col("_entity").alias("entity"), F.col(f"_{n}").alias("value")).where("value is not null") for n in columns})
        if settle:
            engine.settle()
        if after:
            after(number)

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
