"""An immutable version of all component tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Component, Registry
from .storage import Layered

#: Columns of a component table: value, the commit of the last change, its fingerprint, the commit of the insert, and who owns the row.
META = "_rev long, _fp long, _born long, _owner string, _keys array<long>"


@dataclass(frozen=True)
class Fused:
    """A component that is still a column of a source table, as it was loaded by commit ``rev``."""

    source: int
    table: DataFrame
    entity: Column
    column: Column
    rev: int
    made: dict[str, DataFrame] = field(default_factory=dict, compare=False)

    def rows(self, c: Component) -> DataFrame:
        if c.name not in self.made:
            rows = self.table.select(self.entity.alias("entity"), self.column.cast(c.type).alias("value")).where("value IS NOT NULL")
            self.made[c.name] = rows.selectExpr("entity", "value", f"CAST({self.rev} AS BIGINT) AS _rev", f"{c.print_sql('value')} AS _fp", f"CAST({self.rev} AS BIGINT) AS _born", "CAST(NULL AS STRING) AS _owner", "CAST(NULL AS ARRAY<BIGINT>) AS _keys")
        return self.made[c.name]


@dataclass(frozen=True)
class World:
    spark: SparkSession
    registry: Registry
    tables: dict[str, Layered] = field(default_factory=dict)
    fused: dict[str, Fused] = field(default_factory=dict)
    #: Highest commit at which a table changed, and at which it lost a row.
    watermark: dict[str, int] = field(default_factory=dict)
    removed: dict[str, int] = field(default_factory=dict)
    #: Entities that lost the component, with the commit at which they did; back to the oldest plan that may ask.
    lost: dict[str, tuple[tuple[int, DataFrame], ...]] = field(default_factory=dict)
    #: Of tables whose rows are all as they were when their entities were spawned: the commits that spawned them.
    births: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def moved(self, names: set[str], since: int) -> DataFrame | None:
        """Entities of which one of these components was written or removed after ``since``; None if there are none."""
        found = []
        for name in sorted(names):
            if self.watermark.get(name, -1) <= since:
                continue
            found.append(self.table(name).where(f"_rev > {since}").select("entity"))
            found += [gone.select("entity") for rev, gone in self.lost.get(name, ()) if rev > since]
        return reduce(DataFrame.union, found).distinct() if found else None

    def without_lost_before(self, since: int) -> World:
        kept = {n: some for n, all_ in self.lost.items() if (some := tuple(x for x in all_ if x[0] > since))}
        return replace(self, lost=kept)

    def known_empty(self, name: str) -> bool:
        """Whether nothing has this component, as far as it is known without looking."""
        return name not in self.fused and (name not in self.tables or self.tables[name].n == 0)

    def table(self, name: str) -> DataFrame:
        """entity, value and the columns of META."""
        c = self.registry[name]
        if name in self.tables:
            return self.tables[name].rows()
        if name in self.fused:
            return self.fused[name].rows(c)
        return self.spark.createDataFrame([], f"entity long, value {c.type}, {META}")

    def with_table(self, name: str, table: Layered, rev: int, lost: DataFrame | None = None, births: tuple[int, ...] = ()) -> World:
        born = {k: b for k, b in self.births.items() if k != name} | ({name: births} if births else {})
        fused = {k: f for k, f in self.fused.items() if k != name}
        made = replace(self, tables={**self.tables, name: table}, fused=fused, watermark={**self.watermark, name: rev}, births=born)
        if lost is None:
            return made
        return replace(made, removed={**self.removed, name: rev}, lost={**self.lost, name: (*self.lost.get(name, ()), (rev, lost))})

    def entities(self) -> DataFrame:
        """Every entity that has a component."""
        names = sorted({*self.tables, *self.fused})
        if not names:
            return self.spark.createDataFrame([], "entity long")
        return reduce(DataFrame.union, [self.table(n).select("entity") for n in names]).distinct()

    def _unit(self, names: list[str], outer: bool) -> tuple[DataFrame, int | None]:
        """Columns of components that share a source, by one scan; all present unless ``outer``."""
        f = self.fused[names[0]]
        columns = [self.fused[n].column.cast(self.registry[n].type).alias(n) for n in names]
        revs = [F.lit(self.fused[n].rev).cast("long").alias(f"_rev.{n}") for n in names]
        df = f.table.select(f.entity.alias("entity"), *columns, *revs)
        if not outer:
            for n in names:
                df = df.where(F.col(f"`{n}`").isNotNull())
        return df, f.source

    def gather(self, inner: list[str], outer: list[str]) -> DataFrame:
        """entity, and for each component its value and ``_rev.<name>``; rows have all of ``inner``."""
        groups: dict[int | str, list[str]] = {}
        for n in [*inner, *outer]:
            key = self.fused[n].source if n in self.fused else n
            groups.setdefault(key, []).append(n)
        df: DataFrame | None = None if inner else self.entities()
        # groups with a required component first, so that the others join onto them
        for names in sorted(groups.values(), key=lambda g: not set(g) & set(inner)):
            need = [n for n in names if n in inner]
            if names[0] in self.fused:
                part, _ = self._unit(names, True)
                for n in need:
                    part = part.where(F.col(f"`{n}`").isNotNull())
                for n in set(names) - set(need):
                    part = part.withColumn(f"_rev.{n}", F.when(F.col(f"`{n}`").isNotNull(), F.col(f"`_rev.{n}`")))
            else:
                part = self.table(names[0]).selectExpr("entity", f"value AS `{names[0]}`", f"_rev AS `_rev.{names[0]}`")
            df = part if df is None else df.join(part, "entity", "inner" if need else "left")
        return df
