"""The fact engine: writes are queued, rules run to a fixed point, reads see settled versions.

A rule (system) reads rows of one or more parameters.  Its memo has, for each
combination of entities that it ran for, the revisions that it saw; it runs for
those whose revisions differ.  Where every dependency is a present value and
nothing was removed since the rule last ran, only rows with a newer revision can
differ, so the memo isn't read at all.  All rules of a wave commit as one diff:
outputs whose value stays the same keep their revision, so nothing downstream runs again,
and outputs that a rule no longer gives are swept.  After removals, and where a rule looks at
absent or optional values or joins outer, it plans only for entities that were written or lost something
since, and for what was joined to them.

One settle is an epoch: it works on the writes that were there when it began.  Writes of other
threads don't wait for it; they are the next epoch, or, if they preempt, end the wave at hand without
its results and are taken in at once.

State of a version is a set of Parquet tables in the shared folder; a settle
that fails leaves the last settled version as it was.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .model import Component, FactError, Inverse, Plugin, Registry, Shape
from .operators import diff, joins, relationships
from .plans.query import Entity, Eq, Filter, Gte, Maybe, Meta, Mut, Named, Not, Or, Query, Read, Tracked, With, Without, bound, conjuncts, plan, visible, walk
from .sources.tables import Source
from .storage import BROADCAST_ROWS, LAYER_SHARE, PARTS, Layered, Storage, small
from .world import META, Fused, World

PHASES = ("startup", "evaluate", "complete", "settle")
#: Invocations of one settle, waves of one, and runs of one rule by healing in one, at most.
COMMIT_LIMIT, WAVE_LIMIT, HEAL_LIMIT = 10_000, 10_000, 128
#: How often preempting writes may end a wave in one settle; beyond it they wait for the next one.
PREEMPTIONS = 4
#: The first of the entities that the store names itself, and how many a table of new entities may take.
FIRST_ENTITY, BLOCK = 1 << 60, 1 << 52


@dataclass(frozen=True)
class Write:
    """Values of a component on entities that are there: rows has _keys, entity, value."""

    component: str
    rows: DataFrame


@dataclass(frozen=True)
class Spawn:
    """New entities: rows has _keys and a column for each component; ``slot`` tells those of one invocation apart."""

    rows: DataFrame
    components: tuple[str, ...]
    slot: str | None = None
    anchors: str | None = None


@dataclass(frozen=True)
class Remove:
    component: str
    rows: DataFrame


@dataclass(frozen=True)
class Despawn:
    rows: DataFrame


@dataclass(frozen=True)
class System:
    """A rule: body(rows, **views) gives Writes, Spawns, Removes and Despawns.

    rows has ``_keys`` (the entities of its parameters, in order), and for the
    i-th parameter ``p<i>.entity`` and ``p<i>.<component>``.  Views are DataFrames
    of whole queries; they are no dependency.  A view may be a dataclass of queries,
    which the body gets with DataFrames in their place.  With ``keeps`` the body gets
    ``keep``, which writes a DataFrame that several outputs are made from, so that it is worked out once.
    """

    name: str
    params: tuple[Query | Maybe, ...]
    body: Callable[..., Iterable[Any]]
    views: dict[str, Any] = field(default_factory=dict)
    phase: str = "evaluate"
    outputs: tuple[str, ...] = ()
    always: bool = False  # once a generation for all rows, whatever has changed
    keeps: bool = False

    def view_queries(self) -> list[tuple[str, Query | Meta]]:
        """All queries of views, those in a bundle too."""
        return [(name, q) for name, v in self.views.items() for q in (bundled(v).values() if is_dataclass(v) and not isinstance(v, (Query, Meta)) else [v])]


def bundled(bundle: Any) -> dict[str, Any]:
    return {f.name: getattr(bundle, f.name) for f in fields(bundle)}


def system(name: str, *params: Query | Maybe, views: dict[str, Any] | None = None, phase: str = "evaluate", outputs: Iterable[str] = (), always: bool = False, keeps: bool = False) -> Callable[[Callable], System]:
    return lambda body: System(name, params, body, views or {}, phase, tuple(outputs), always, keeps)


def query_of(p: Query | Maybe) -> Query:
    return p.query if isinstance(p, Maybe) else p


@dataclass
class _State:
    """What the engine knows of a system: its memo, when it last planned, and counters."""

    memo: Layered | None = None
    planned: int = -1
    stale: bool = True
    views: int = -1
    heals: int = 0
    generation: int = -1
    runs: int = 0
    waves: int = 0
    plan_s: float = 0.0
    run_s: float = 0.0
    #: Keys of invocations that the memo has lost to a removal since it last planned.
    forgotten: tuple[DataFrame, ...] = ()


class _Preempted(Exception):
    pass


class Engine:
    """A store of facts and the rules over it.

    ``commit_limit`` bounds the invocations that one settle may commit; give None where rules run over whole tables.
    With ``strict`` a rule that writes what another of its phase views in the same wave is an error, else a warning.
    """

    def __init__(self, spark: SparkSession, components: Iterable[Component] = (), shapes: Iterable[Shape] = (), systems: Iterable[System] = (), plugins: Iterable[Plugin] = (), commit_limit: int | None = COMMIT_LIMIT, wave_limit: int | None = WAVE_LIMIT, strict: bool = False):
        plugins = list(plugins)
        self.spark, self.registry, self.storage = spark, Registry(), Storage(spark)
        for c, s in [(components, shapes), *((p.components, p.shapes) for p in plugins)]:
            self.registry.add(c, s)
        self.registry.check()
        self.systems = [*systems, *(s for p in plugins for s in p.systems)]
        self.commit_limit, self.wave_limit, self.strict = commit_limit, wave_limit, strict
        self.world = World(spark, self.registry)
        self.settled = self.world
        self.revision = 0
        self.state: dict[str, _State] = {}
        self.warnings: list[str] = []
        self._queue: list[Callable[[], None]] = []  # writes for the next epoch
        self._inner: list[Callable[[], None]] = []  # writes of hooks while a settle runs: a generation more of it
        self._inbox = threading.Lock()
        self._driver: int | None = None  # the thread that settles
        self._preempting, self._preemptions = False, 0
        self._blocks, self._named = 0, FIRST_ENTITY
        self._late: list[tuple[System, list[Any]]] = []
        self._watch: list[Callable[[int], None]] = []
        self._hooks: dict[str, list[Callable[[str], None]]] = {"start": [], "complete": [], "settled": []}
        self._lock = threading.RLock()
        self._sources = 0
        self._cleaned: dict[str, int] = {}
        # what anchors came from that were written without looking up revisions; and revisions of whole tables, as they were found
        self._sure: dict[str, set[tuple[str, int]]] = {}
        self._uniforms: dict[tuple, int | None] = {}
        self._wrote: dict[str, set[str]] = {}
        self._news: dict[str, tuple[DataFrame, DataFrame]] = {}
        self.counters = {"settles": 0, "generations": 0, "waves": 0, "commits": 0, "preemptions": 0}
        for s in self.systems:
            self._register(s)

    # -- declaration -----------------------------------------------------

    def _register(self, s: System) -> None:
        if s.name in self.state:
            raise FactError(f"{s.name} is registered twice")
        if s.phase not in PHASES:
            raise FactError(f"{s.name}: no phase {s.phase}")
        if not 1 <= len(s.params) <= 8:
            raise FactError(f"{s.name}: 1 to 8 parameters")
        for i, p in enumerate(s.params):
            q = query_of(p)
            b = bound(q.where)
            for c in [*q.reads(), *q.optional(), *(f.component for f in walk(q.where) if hasattr(f, "component"))]:
                self.registry[c]
            if isinstance(p, Maybe) and not b.keys:
                raise FactError(f"{s.name}: an outer parameter needs an equality")
            for key in b.keys:
                self._provider(s, i, key)
                if not self.registry[key].fingerprinted:
                    raise FactError(f"{s.name}: {key} has no fingerprint to join on")
            if b.members:
                self._provider(s, i, b.members)
                if b.keys:
                    raise FactError(f"{s.name}: a parameter is bound by equality or by membership, not by both")
        for name, v in s.view_queries():
            if isinstance(v, Meta):
                if not self.registry[v.component].provenance:
                    raise FactError(f"{s.name}: {v.component} holds no provenance")
                continue
            b = bound(v.where)
            if b.keys or b.members:
                raise FactError(f"{s.name}: view {name} cannot be bound")
        for c in s.outputs:
            self.registry[c]
            for other in self.systems:
                seen = self._viewed(other)
                if other is not s and other.phase == s.phase and c in seen:
                    self.warnings.append(f"{other.name} views {c}, which {s.name} writes in the same phase")
        self.state[s.name] = _State()

    def _viewed(self, s: System) -> set[str]:
        return {c for _, q in s.view_queries() if not isinstance(q, Meta) for c in self._view_interest(q)}

    def _provider(self, s: System, i: int, key: str) -> int:
        found = [j for j, p in enumerate(s.params) if j != i and key in query_of(p).reads()]
        if len(found) != 1:
            raise FactError(f"{s.name}: {key} has {len(found)} providers, one is needed")
        return found[0]

    def on(self, event: str, callback: Callable[[str], None]) -> None:
        """``start`` and ``complete`` of each system's batch, ``settled`` after each settle that did work."""
        self._hooks[event].append(callback)

    def insert_on(self, event: str, entity: int | None = None, **values: Any) -> None:
        """Put a bundle whenever the event happens; it is part of the next settle."""
        self.on(event, lambda _: self.put(entity, **values))

    # -- base writes -----------------------------------------------------

    def _put(self, work: Callable[[], None], preempt: bool = False) -> None:
        """Queue a write; one that a running settle's own hooks make is part of that settle, one of another thread is not waited for."""
        with self._inbox:
            if self._driver == threading.get_ident():
                self._inner.append(work)
                return
            self._queue.append(work)
            self._preempting |= preempt and self._driver is not None

    def load(self, source: Source) -> None:
        """Components over a table's columns, without copying it."""
        for c in source.columns:
            self.registry[c]

        def work() -> None:
            self._sources += 1
            self.revision += 1
            for name, column in source.columns.items():
                if name in self.world.tables or name in self.world.fused:
                    rows = source.table.select(source.entity.alias("entity"), column.cast(self.registry[name].type).alias("value")).where("value is not null")
                    self._base({name: rows})
                    continue
                f = Fused(self._sources, source.table, source.entity, column, self.revision)
                self.world = replace(self.world, fused={**self.world.fused, name: f}, watermark={**self.world.watermark, name: self.revision})
                if self.registry[name].target:
                    self._invert(name, None)

        self._put(work)

    def insert(self, _preempt: bool = False, **rows: DataFrame) -> None:
        """Facts by component: each DataFrame has entity and value; an entity's old value is replaced."""
        self._writable(rows)
        self._put(lambda: self._base(rows), _preempt)

    def _writable(self, names: Iterable[str]) -> None:
        for name in names:
            if isinstance(self.registry[name], Inverse):
                raise FactError(f"{name} is kept by the store")
        if sum(self.registry[n].singleton for n in names) > 1:
            raise FactError("one singleton at most in a bundle")

    def insert_rows(self, table: DataFrame, entity: str | None = None, **columns: str) -> None:
        """A bundle: one row an entity, a column for each component; a null column is a component left out.

        Without a column of entities each row gets a new one; those of a later call are greater.
        """
        if entity is None:
            with self._inbox:
                self._blocks += 1
                first = FIRST_ENTITY + self._blocks * BLOCK
            table, entity = self.storage.save(table.withColumn("_entity", F.monotonically_increasing_id() + F.lit(first))), "_entity"
        self._writable(columns)
        some = table.select(F.col(entity).cast("long").alias("entity"), *[F.col(c).cast(self.registry[n].type).alias(n) for n, c in columns.items()]).where("entity is not null")

        def work() -> None:
            held, n = self._held(some, columns)  # written once for all of its columns
            self._base({c: held.select("entity", F.col(f"`{c}`").alias("value")) for c in columns}, n)

        self._put(work)

    def put(self, entity: int | None = None, _preempt: bool = False, **values: Any) -> int:
        """One entity's bundle of plain values; without an entity, that of its singleton, else a new one.  Which one it is.

        A preempting one does not wait for the end of a settle that another thread runs.
        """
        marker = [n for n in values if self.registry[n].singleton]
        if len(marker) > 1:
            raise FactError("one singleton at most in a bundle")
        if marker:
            entity = self.registry.singleton_entity(marker[0])
        if entity is None:
            with self._inbox:
                entity, self._named = self._named, self._named + 1
        self.insert(_preempt, **{n: self.spark.createDataFrame([(entity, v)], f"entity long, value {self.registry[n].type}") for n, v in values.items()})
        return entity

    def remove(self, component: str, entities: DataFrame | list[int]) -> None:
        ids = self._ids(entities)
        self._put(lambda: self._commit({}, {}, {component: ids}, None))

    def despawn(self, entities: DataFrame | list[int]) -> None:
        """Entities with all their components, and what rules derived from them."""
        ids = self._ids(entities)
        self._put(lambda: self._commit({}, {}, {}, ids, external=True))

    def update(self, component: str, value: Column, where: Filter | None = None, _preempt: bool = False, **args: Any) -> None:
        """A new value for each row that meets the filter: an expression over the old one, ``value``, and the entity."""

        def work() -> None:
            c = self.registry[component]
            if isinstance(c, Inverse):
                raise FactError(f"{component} is kept by the store")
            before, rev = self.world.table(component), self.revision + 1
            layer, old, size = None, before, Observation()
            if component in self.world.fused:  # its size is counted as it is read
                old = old.observe(size, F.count(F.lit(1)).alias("n"))
            else:
                layer = self._layer(component)
            if where is not None:
                q = Query(Entity(), Read(component), where=where)
                old = old.join(plan(self.world, self.registry, q, args).rows.select("entity"), "entity", "left_semi")
            change, n = self.storage.counted(diff.replaced(c, old, rev, value.cast(c.type)))
            if not n["n"]:
                return
            layer = layer or Layered("entity", before, size.get["n"], None, 0, size.get["n"])
            self._lay(component, layer, change, n["n"], layer.n, rev, n["n"], 0)
            if c.target:
                self._invert(component, before, rev)
            self.revision = rev
            self.counters["commits"] += 1

        self._put(work, _preempt)

    def compare_and_set(self, entity: int, component: str, value: Any, seen: int | None = None) -> bool:
        """Set one value now; with ``seen``, only if its revision is still that.  False if it isn't, or there is none."""
        with self._lock:
            self.settle()
            row = self.world.table(component).where(F.col("entity") == entity).select("_rev").first()
            if row is None or seen is not None and row[0] != seen:
                return False
            self.put(entity, **{component: value})
            return True

    def with_latest(self, entity: int, component: str, change: Callable[[Any], Any]) -> Any:
        """Replace one value by a function of what it is now; the new value, or None if there is none."""
        with self._lock:
            self.settle()
            row = self.world.table(component).where(F.col("entity") == entity).select("value").first()
            if row is None:
                return None
            new = change(row[0])
            self.put(entity, **{component: new})
            return new

    def revision_of(self, entity: int, component: str) -> int | None:
        self.settle()
        row = self.world.table(component).where(F.col("entity") == entity).select("_rev").first()
        return None if row is None else row[0]

    def _ids(self, entities: DataFrame | list[int]) -> DataFrame:
        if isinstance(entities, list):
            return self.spark.createDataFrame([(e,) for e in entities], "entity long")
        return entities.select("entity")

    def _held(self, rows: DataFrame, components: Iterable[str]) -> tuple[DataFrame, dict[str, int]]:
        """``rows`` saved, and for each of these columns how many values it has."""
        names = list(components)
        held, seen = self.storage.counted(rows, **{f"_{i}": F.count(F.col(f"`{c}`")) for i, c in enumerate(names)})
        return held, {c: seen[f"_{i}"] or 0 for i, c in enumerate(names)}

    def _base(self, rows: dict[str, DataFrame], held: dict[str, int] | None = None) -> None:
        new = {}
        for name, df in rows.items():
            c = self.registry[name]
            value = df.select((F.lit(self.registry.singleton_entity(name)) if c.singleton else F.col("entity").cast("long")).alias("entity"), F.col("value").cast(c.type).alias("value"), F.lit(None).cast("string").alias("_owner"), F.lit(None).cast("array<long>").alias("_keys"))
            new[name] = value.where("value is not null and entity is not null")
        self._commit(new, {}, {}, None, held=held)

    # -- commit ----------------------------------------------------------

    def _commit(self, new: dict[str, DataFrame], swept: dict[str, DataFrame], gone: dict[str, DataFrame], despawned: DataFrame | None, external: bool = False, n_swept: int | None = None, held: dict[str, int] | None = None, fresh: frozenset[str] = frozenset()) -> bool:
        """Apply writes, sweeps (by component) and removals as one diff; whether anything changed.

        ``held`` has the rows of what is written from saved tables; components of ``fresh`` are only written to entities spawned just now.
        """
        rev = self.revision + 1
        w = self.world
        names = {*new, *swept, *gone}
        if despawned is not None:
            despawned = self.storage.save(despawned.distinct())
            names |= {*w.tables, *w.fused}
            for c in self.registry.components.values():
                if c.on_entity_remove:
                    c.on_entity_remove(w.table(c.name).join(despawned, "entity", "left_semi"))
        changed: dict[str, DataFrame] = {}
        for name in sorted(names):
            c = self.registry[name]
            if isinstance(c, Inverse) and name not in new:
                continue
            lost = [x.select("entity") for x in (gone.get(name), despawned) if x is not None]
            if c.target and despawned is not None:  # edges at removed targets go too
                at = w.table(name).withColumn("_at", c.target_of(F.col("value")))
                lost.append(at.join(despawned.withColumnRenamed("entity", "_e"), F.col("_at") == F.col("_e"), "left_semi").select("entity"))
            leaving = reduce(DataFrame.union, lost) if lost else None
            if name not in new and name not in swept and w.table(name).join(leaving, "entity", "left_semi").isEmpty():
                continue
            if self._write(name, new.get(name), swept.get(name), leaving, rev, (held or {}).get(name), n_swept, name in fresh):
                changed[name] = w.table(name)
        for name, before in changed.items():
            if self.registry[name].target:
                self._invert(name, before, rev)
        if changed:
            self.revision = rev
            self.counters["commits"] += 1
        if despawned is not None:
            self._retire(despawned, external)
        if not external and (gone or despawned is not None):
            self._reopen({n: w.table(n) for n in changed}, gone, despawned)
        return bool(changed)

    def _reopen(self, before: dict[str, DataFrame], gone: dict[str, DataFrame], despawned: DataFrame | None) -> None:
        """Joined rules forget invocations whose outputs were removed from outside, so that those still live give them again."""
        for s in self.systems:
            st = self.state[s.name]
            if st.memo is None or not any(bound(query_of(p).where).keys or bound(query_of(p).where).members for p in s.params):
                continue
            lost = [t.where(F.col("_owner") == s.name).join(x.select("entity"), "entity", "left_semi").select("_keys") for n, t in before.items() for x in (gone.get(n), despawned) if x is not None]
            if not lost:
                continue
            dead, seen = self.storage.counted(reduce(DataFrame.union, lost).distinct())
            if seen["n"]:
                st.memo, st.stale = self._forget(st.memo, dead, seen["n"]), True

    def _forget(self, memo: Layered, keys: DataFrame, n: int) -> Layered:
        gone = keys.select("_keys", F.lit(None).cast("array<long>").alias("_deps"), F.lit(True).alias("_dead"))
        return memo.put(self.storage, gone, n, memo.n)

    def _remember(self, memo: Layered | None, seen: DataFrame, n: int) -> Layered:
        """Memo with these invocations at the revisions that they saw."""
        if memo is None:
            return Layered("_keys", seen, n, None, 0, n)
        return memo.put(self.storage, seen.withColumn("_dead", F.lit(False)), n, memo.n + n)

    def _write(self, name: str, new: DataFrame | None, swept: DataFrame | None, gone: DataFrame | None, rev: int, n_new: int | None = None, n_swept: int | None = None, fresh: bool = False) -> bool:
        """Change one table by one grouping of the rows that it touches; what it costs to write is what changes, unless that is much of the table.

        Rows of entities that have no row yet are put beside those that are there, without a grouping.
        """
        c = self.registry[name]
        layer, old = self._layer(name), self.world.table(name)
        if new is not None and swept is None and gone is None:
            change = new.selectExpr("entity", "value", f"CAST({rev} AS BIGINT) AS _rev", f"{c.print_sql('value')} AS _fp", f"CAST({rev} AS BIGINT) AS _born", "_owner", "_keys")
            if n_new is None:
                change, seen = self.storage.counted(change)
                new, n_new = change.select("entity", "value", "_owner", "_keys"), seen["n"]
            if not n_new:
                return False
            if n_new > min(LAYER_SHARE * layer.n, BROADCAST_ROWS) and self._distinct(change, old if layer.n else None):
                self._lay(name, layer, change, n_new, layer.n + n_new, rev, n_new, 0, added=True, fresh=fresh)
                return True
        if new is not None and (n_new is None or layer.n):
            new, seen = (new, {"n": n_new}) if n_new is not None and swept is None and gone is None else self.storage.counted(new)
            n_new = seen["n"]
        if gone is not None:
            gone, seen = self.storage.counted(gone.select("entity").distinct())
            n_gone = seen["n"]
        if not layer.n:
            touched: list[tuple[DataFrame, str]] = []
            whole = True
        else:
            whole = (n_new or 0) + (n_swept or 0) + (n_gone if gone is not None else 0) > LAYER_SHARE * layer.n
            touched = [(old, "kept")] if whole else [(old.join(small(new.select("entity"), n_new), "entity", "left_semi"), "kept")] if n_new else []
            if swept is not None:
                ran = small(swept.selectExpr("_owner AS _so", "_keys AS _sk"), n_swept or 0)
                touched.append((old.join(ran, F.expr("_owner = _so AND _keys = _sk"), "left_semi"), "swept"))
            if gone is not None and n_gone:
                touched.append((old.join(small(gone, n_gone), "entity", "left_semi"), "gone"))
        if n_new == 0:
            new = None
        if not touched and new is None:
            return False
        change = diff.merge(c, rev, touched, new)
        change = change.drop("_moved") if whole else change.where("_moved").drop("_moved")
        change, now = self.storage.counted(change, changed=F.expr(f"count_if(NOT _dead AND _rev = {rev})"), born=F.expr(f"count_if(NOT _dead AND _born = {rev})"), lost=F.expr("count_if(_dead)"))
        if not now["n"] or whole and not now["changed"] and not now["lost"]:
            return False
        after = layer.n + now["born"] - now["lost"]
        fresh = fresh and n_new == now["born"] == now["changed"] and not now["lost"]
        self._lay(name, layer, change, now["n"], after, rev, now["changed"], now["lost"], whole, fresh=fresh)
        return bool(now["changed"] or now["lost"])

    def _distinct(self, rows: DataFrame, old: DataFrame | None) -> bool:
        """Whether no entity is there twice, among ``rows`` and those of ``old`` together: only entities are shuffled."""
        ids = rows.select("entity") if old is None else rows.select("entity").union(old.select("entity"))
        return ids.groupBy("entity").count().agg(F.max("count")).first()[0] == 1

    def _lay(self, name: str, layer: Layered, change: DataFrame, n: int, after: int, rev: int, changed: int, lost: int, whole: bool = False, added: bool = False, fresh: bool = False) -> None:
        """The world with ``change`` (saved, with _dead) on a table; what moved is news.  If it is ``added``, no row of it was there before and none is dead."""
        c = self.registry[name]
        if added:
            change = change.withColumn("_dead", F.lit(False))
            rows = change.drop("_dead")
            if layer.n:
                rows = layer.rows().unionByName(rows)
            parts = layer.parts + 1 if layer.n else 1
            if parts > PARTS:
                rows, parts = self.storage.save(rows), 1
            table = Layered("entity", rows, after, None, 0, after, parts)
        else:
            table = Layered("entity", change.where("NOT _dead").drop("_dead"), after, None, 0, after) if whole else layer.put(self.storage, change, n, after)
        news, gone = change.where(f"NOT _dead AND _rev = {rev}").drop("_dead"), change.where("_dead").drop("_dead")
        if c.on_insert and changed:
            c.on_insert(news)
        if c.on_remove and lost:
            c.on_remove(gone)
        self._news[name] = (news.select("entity", "value"), gone.select("entity"))
        if changed or lost:
            births = (*self.world.births.get(name, ()), rev) if fresh and (not layer.n or name in self.world.births) else ()
            self.world = self.world.with_table(name, table, rev, gone.select("entity") if lost else None, births)
        else:  # other owners of the same values
            self.world = replace(self.world, tables={**self.world.tables, name: table}, fused={k: f for k, f in self.world.fused.items() if k != name})

    def _layer(self, name: str) -> Layered:
        if name in self.world.tables and self.world.tables[name].n >= 0:
            return self.world.tables[name]
        table = self.world.table(name)
        if name in self.world.tables:
            table, seen = self.storage.counted(table)
            return Layered("entity", table, seen["n"], None, 0, seen["n"])
        n = self.storage.count(table) if name in self.world.fused else 0
        return Layered("entity", table, n, None, 0, n)

    def _invert(self, edge: str, before: DataFrame | None, rev: int | None = None) -> None:
        """Keep the inverses of an edge: those of the targets that changed edges left or reached."""
        rev = self.revision if rev is None else rev
        target = self.registry[edge].target_of(F.col("value"))
        now = self.world.table(edge)
        for inv in self.registry.inverses(edge):
            form = relationships.inverse if inv.lists else relationships.digest
            if before is None:  # of a loaded table: worked out when it is read, written when it first changes
                meta = {"_rev": F.lit(rev).cast("long"), "_fp": inv.fingerprint(F.col("value")), "_born": F.lit(rev).cast("long"), "_owner": F.lit(None).cast("string"), "_keys": F.lit(None).cast("array<long>")}
                self.world = self.world.with_table(inv.name, Layered("entity", form(now, target).withColumns(meta), -1, None, 0, -1), rev)
                continue
            fresh, lost = self._news[edge]
            moved = fresh.select("entity").union(lost)
            left = before.join(moved, "entity", "left_semi")
            touched = self.storage.save(fresh.select(target.alias("target")).union(left.select(target.alias("target"))).where("target is not null").distinct())
            held, seen = self.storage.counted(form(relationships.affected(touched, now, target), target))
            gone = touched.select(F.col("target").alias("entity")).join(held, "entity", "left_anti")
            owned = held.select("entity", "value", F.lit(None).cast("string").alias("_owner"), F.lit(None).cast("array<long>").alias("_keys"))
            self._write(inv.name, owned, None, gone, rev, seen["n"])

    def _retire(self, entities: DataFrame, external: bool) -> None:
        """Memos and outputs of invocations that a removed entity took part in; of joined rules only, if a rule removed it."""
        orphans: list[tuple[DataFrame, int]] = []
        for s in self.systems:
            pairwise = any(bound(query_of(p).where).keys or bound(query_of(p).where).members for p in s.params)
            st = self.state[s.name]
            if st.memo is None or not (external or pairwise):
                continue
            dead, seen = self.storage.counted(st.memo.rows().withColumn("_e", F.explode("_keys")).join(entities.withColumnRenamed("entity", "_e"), "_e", "left_semi").select("_keys").distinct())
            if not seen["n"]:
                continue
            st.memo, st.forgotten = self._forget(st.memo, dead, seen["n"]), (*st.forgotten, dead)
            orphans.append((dead.select(F.lit(s.name).alias("_owner"), "_keys"), seen["n"]))
        if orphans:
            owners = reduce(DataFrame.union, [o for o, _ in orphans])
            spawned = self._owned_entities(owners)
            self._commit({}, {n: owners for n in [*self.world.tables] if self._wrote.get(n)}, {}, None, n_swept=sum(n for _, n in orphans))
            if spawned is not None and not spawned.isEmpty():
                self._retire(spawned, external)

    def _owned_entities(self, owners: DataFrame) -> DataFrame | None:
        """Entities that rules of ``owners`` spawned: negative, and owned."""
        found = [self.world.table(n).join(owners, ["_owner", "_keys"], "left_semi").where("entity < 0").select("entity") for n in self.world.tables if self._wrote.get(n)]
        return self.storage.save(reduce(DataFrame.union, found).distinct()) if found else None

    # -- planning --------------------------------------------------------

    def _params(self, s: System, world: World) -> list[tuple[DataFrame, list[str], list[str]]]:
        """For each parameter: rows with prefixed columns, its dependency columns, all revision columns."""
        out = []
        for i, p in enumerate(s.params):
            q = query_of(p)
            b = bound(q.where)
            planned = plan(world, self.registry, Query(*q.parts, where=b.rest), {}, b.keys)
            absent = {f.component for f in walk(b.rest) if isinstance(f, Without)}
            seen = [*planned.required, *planned.optional, *planned.filters, *b.keys]
            deps = [f"_rev.{c}" for c in dict.fromkeys(seen) if not self.registry[c].untracked and c not in absent]
            columns = planned.rows.columns
            renamed = planned.rows.selectExpr(*[f"`{c}` AS `p{i}.{c}`" for c in columns])
            out.append((renamed, [f"p{i}.{c}" for c in deps if c in columns], [f"p{i}.{c}" for c in columns if c.startswith("_rev.")]))
        return out

    def _joined(self, s: System, parts: list[DataFrame], world: World) -> DataFrame:
        """The rows of a rule: parameters joined in order, those whose providers come later after them."""
        done: set[int] = set()
        rows: DataFrame | None = None
        waiting = list(range(len(parts)))
        while waiting:
            ready = [i for i in waiting if not self._needs(s, i) - done]
            if not ready:
                raise FactError(f"{s.name}: parameters bind each other in a circle")
            i = ready[0]
            waiting.remove(i)
            p, b = s.params[i], bound(query_of(s.params[i]).where)
            right = parts[i]
            if rows is None:
                rows = right
            elif b.keys:
                pairs = [(f"p{self._provider(s, i, k)}.{k}", f"p{i}.{k}") for k in b.keys]
                rows = joins.equality(rows, right, pairs, isinstance(p, Maybe))
            elif b.members:
                j, m = self._provider(s, i, b.members), self.registry[b.members]
                if isinstance(m, Inverse):
                    edges = world.table(m.edge).select(self.registry[m.edge].target_of(F.col("value")).alias("_at"), F.col("entity").alias("_member"))
                    rows = joins.along_edges(rows.drop(f"p{j}.{m.name}"), edges, right, f"p{j}.entity", f"p{i}.entity")
                else:
                    rows = joins.membership(rows, right, f"p{j}.{m.name}", f"p{i}.entity")
            else:
                rows = joins.product(rows, right)
            done.add(i)
        return rows

    def _needs(self, s: System, i: int) -> set[int]:
        b = bound(query_of(s.params[i]).where)
        return {self._provider(s, i, k) for k in [*b.keys, *([b.members] if b.members else [])]}

    def _interest(self, s: System) -> set[str]:
        found: set[str] = set()
        for p in s.params:
            q = query_of(p)
            found |= {*q.reads(), *q.optional(), *(f.component for f in walk(q.where) if hasattr(f, "component"))}
            for shape in q.shapes():
                found |= self.registry.shapes[shape].parts
            if not found or all(isinstance(x, Entity) and not x.shape for x in q.parts):
                found |= {*self.registry.components}
        return found

    def _param_interest(self, p: Query | Maybe) -> set[str]:
        """Components that decide which rows a parameter has and what it depends on."""
        q = query_of(p)
        found = {*q.reads(), *q.optional(), *(f.component for f in walk(q.where) if hasattr(f, "component")), *bound(q.where).keys}
        for shape in q.shapes():
            found |= self.registry.shapes[shape].parts
        if not found or all(isinstance(x, Entity) and not x.shape for x in q.parts) and not q.where:
            found |= {*self.registry.components}
        return found

    def _by_entity(self, p: Query | Maybe, since: int) -> bool:
        """Whether newer revisions of its rows don't tell all that is new of a parameter: something may be absent, or was removed."""
        q = query_of(p)
        absence = bool(q.optional()) or any(isinstance(x, Tracked) for x in q.parts) or any(isinstance(f, (Without, Not, Or)) for f in walk(q.where))
        return absence or any(self.world.removed.get(c, -1) > since for c in self._param_interest(p))

    def _rows_of(self, df: DataFrame, column: str, entities: DataFrame | None, how: str) -> DataFrame:
        if entities is None:
            return df.where(F.lit(False)) if how == "left_semi" else df
        return df.join(entities.withColumnRenamed("entity", "_moved"), F.col(f"`{column}`") == F.col("_moved"), how)

    def _plan(self, s: System, world: World, since: int | None, st: _State | None = None) -> DataFrame:
        """_keys, _deps and the parameters' columns; with ``since``, of rows of which something is newer or went after it."""
        params = self._params(s, world)
        outer = any(isinstance(p, Maybe) for p in s.params)
        whole = [df for df, _, _ in params]
        if since is None:
            rows = self._joined(s, whole, world)
        elif outer:
            # the rows of first entities that something happened to, or to what they are or were joined to
            moved = [world.moved(self._param_interest(p), since) for p in s.params]
            first = [] if moved[0] is None else [moved[0]]
            held = F.col("_keys")
            for i in range(1, len(params)):
                if moved[i] is not None:
                    near = [self._rows_of(df, f"p{i}.entity", moved[i], "left_semi") if j == i else df for j, df in enumerate(whole)]
                    first.append(self._joined(s, near, world).where(F.col(f"`p{i}.entity`").isNotNull()).select(F.col("`p0.entity`").alias("entity")))
                    first.append(st.memo.rows().select(held[0].alias("entity"), held[i].alias("_moved")).join(moved[i].withColumnRenamed("entity", "_moved"), "_moved", "left_semi").select("entity"))
            first += [gone.select(held[0].alias("entity")) for gone in st.forgotten]
            some = reduce(DataFrame.union, first).where("entity is not null").distinct() if first else None
            rows = self._joined(s, [self._rows_of(whole[0], "p0.entity", some, "left_semi"), *whole[1:]], world)
        else:
            # one union member a parameter: its changed rows with all rows of those before and the unchanged of those after
            new, old = [], []
            for i, (df, _, revs) in enumerate(params):
                if self._by_entity(s.params[i], since):
                    moved = world.moved(self._param_interest(s.params[i]), since)
                    new.append(self._rows_of(df, f"p{i}.entity", moved, "left_semi"))
                    old.append(self._rows_of(df, f"p{i}.entity", moved, "left_anti"))
                else:
                    newer = joins.greatest_of(revs) > since
                    new.append(df.where(newer))
                    old.append(df.where(~newer))
            rows = reduce(DataFrame.unionByName, [self._joined(s, [new[j] if j == i else old[j] if j > i else df for j, df in enumerate(whole)], world) for i in range(len(params))])
        deps = [f"`{c}`" for _, d, _ in params for c in d]
        if outer:
            # an unmatched row depends on the whole tables that it found no partner in
            for i, p in enumerate(s.params):
                if isinstance(p, Maybe):
                    mark = max((world.watermark.get(c, 0) for c in [*query_of(p).reads(), *bound(query_of(p).where).keys]), default=0)
                    deps.append(f"IF(`p{i}.entity` IS NULL, CAST({mark} AS BIGINT), NULL)")
        keys = ", ".join(f"`p{i}.entity`" for i in range(len(params)))
        return rows.selectExpr("*", f"array({keys}) AS _keys", f"CAST(array({', '.join(deps)}) AS ARRAY<BIGINT>) AS _deps")

    def _own(self, s: System) -> set[str]:
        """Components that a rule both reads and writes, as far as it is declared or has been seen."""
        reads = {c for p in s.params for c in self._param_interest(p)}
        muts = {x.component for p in s.params for x in query_of(p).parts if isinstance(x, Mut)}
        return muts | reads & {*s.outputs, *(c for c, who in self._wrote.items() if s.name in who)}

    def _without_rows(self, s: System) -> bool:
        """Whether a component that some parameter must have is known to be nowhere: there is nothing to plan then."""
        for p in s.params:
            if isinstance(p, Maybe):
                continue
            q = query_of(p)
            needed = [*q.reads(), *bound(q.where).keys, *(f.component for f in conjuncts(bound(q.where).rest) if isinstance(f, (With, Eq, Gte)))]
            if any(self.world.known_empty(c) for c in needed):
                return True
        return False

    def _todo(self, s: System) -> tuple[DataFrame, DataFrame, int] | None:
        """The rows of the invocations that must run, their _keys and _deps, saved, and their number; None if there are none."""
        st, w = self.state[s.name], self.world
        always = s.always or any(isinstance(q, Meta) for _, q in s.view_queries())
        always = always and st.generation != self.counters["generations"]  # once a generation
        st.generation = self.counters["generations"]
        interest = self._interest(s)
        high = max((w.watermark.get(c, -1) for c in interest), default=-1)
        if high <= st.planned and not st.stale and not always:
            return None  # nothing that it reads has moved: no Spark job
        if self._without_rows(s):
            st.planned, st.stale, st.forgotten = self.revision, False, ()
            return None
        began = time.time()
        # revisions of untracked components say nothing, so only their presence can be compared, in all rows
        delta = not (st.stale or always or st.memo is None or any(self.registry[c].untracked for c in interest))
        rows = self._plan(s, w, st.planned if delta else None, st)
        by_memo = st.memo is not None and not always and (not delta or any(isinstance(p, Maybe) or self._by_entity(p, st.planned) for p in s.params) or bool(self._own(s)))
        if by_memo:
            seen = st.memo.rows().selectExpr("_keys AS _mk", "_deps AS _md")
            rows = rows.join(seen, F.expr("_keys <=> _mk AND _deps <=> _md"), "left_anti")
        waits = 0
        targets = [i for i, p in enumerate(s.params) if any(isinstance(x, Mut) for x in query_of(p).parts)]
        if targets and len(s.params) > 1:  # one invocation of those that write an entity runs in a wave
            at = [F.col(f"`p{i}.entity`") for i in targets]
            names = rows.columns
            one = rows.groupBy(*[c.alias(f"_t{k}") for k, c in enumerate(at)]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), "_keys").alias("_r"), F.count("*").alias("_all"))
            held, n = self.storage.counted(one.select(*[F.col(f"_r.`{c}`").alias(c) for c in names], "_all"), all=F.sum("_all"))
            rows, todo, n, waits = held.drop("_all"), held.select("_keys", "_deps"), n["n"], (n["all"] or 0) - n["n"]
        elif len(s.params) == 1 and not by_memo and not always:
            # planning is one scan, so values are read again by the body instead of written here
            todo, n = self.storage.counted(rows.select("_keys", "_deps"))
            n = n["n"]
        else:
            rows, n = self.storage.counted(rows)
            todo, n = rows.select("_keys", "_deps"), n["n"]
        st.planned, st.stale, st.forgotten = self.revision, waits > 0, ()
        st.plan_s += time.time() - began
        return (rows, todo, n) if n else None

    # -- settling --------------------------------------------------------

    def settle(self) -> int:
        """Apply queued writes and run rules until nothing runs; the settled revision.

        If it fails, all is as it was before, the queued writes too.
        """
        with self._lock:
            if self._driver is not None:
                return self.settled_revision  # a hook asks; the settle that it is part of goes on
            if not self._queue and not self._late and not any(st.stale for st in self.state.values()):
                return self.settled_revision
            states = {k: replace(v) for k, v in self.state.items()}
            before = (self.world, self.revision, states, list(self._late), dict(self._cleaned), {c: set(x) for c, x in self._wrote.items()}, dict(self._news), {c: set(x) for c, x in self._sure.items()})
            self._uniforms = {}
            taken: list[Callable[[], None]] = []
            with self._inbox:
                self._driver = threading.get_ident()
            try:
                worked = self._settle(taken)
                self.settled = self.world
            except BaseException:
                self.world, self.revision, self.state, self._late, self._cleaned, self._wrote, self._news, self._sure = before
                with self._inbox:
                    self._queue = [*taken, *self._queue]
                raise
            finally:
                with self._inbox:
                    # what hooks have put after the last generation is part of the next epoch
                    self._queue, self._inner = [*self._inner, *self._queue] if self._driver and self.settled is self.world else self._queue, []
                    self._driver, self._preempting = None, False
            self.counters["settles"] += 1
            if worked:
                for callback in self._watch:
                    callback(self.revision)
                for callback in self._hooks["settled"]:
                    callback(str(self.revision))
            return self.revision

    @property
    def settled_revision(self) -> int:
        return self.revision

    def next_settle(self, callback: Callable[[int], None]) -> None:
        """Call back after each settle that did work."""
        self._watch.append(callback)

    def _settle(self, taken: list[Callable[[], None]]) -> bool:
        start, committed, self._waves, self._preemptions = self.revision, 0, 0, 0
        for st in self.state.values():
            st.heals = 0
        startup, arrived = True, True
        while True:
            with self._inbox:
                work, self._inner = self._inner, []
                if arrived:  # the epoch's writes: those that were there when it began, or when one preempted
                    taken += self._queue
                    work, self._queue, self._preempting = [*self._queue, *work], [], False
            arrived = False
            late, self._late = self._late, []
            for each in work:
                each()
            for s, outputs in late:
                self._apply([(s, None, 0, outputs)])
            self.counters["generations"] += 1
            try:
                while True:
                    moved = False
                    for phase in PHASES[:3]:
                        if phase == "startup" and not startup:
                            continue
                        committed, ran = self._phase(phase, committed)
                        moved |= ran
                    startup = False
                    if not moved and not self._clean() and not self._heal():
                        break
                committed, ran = self._phase("settle", committed, once=True)
            except _Preempted:
                self.counters["preemptions"] += 1
                startup = arrived = True
                continue
            if not ran and not self._inner:
                break
            if not any(self._dirty(s) for s in self.systems if s.phase != "settle") and not self._inner:
                break
        for st in self.state.values():
            st.stale = False
        self.world = self.world.without_lost_before(min((st.planned for st in self.state.values()), default=self.revision))
        return self.revision != start

    def _check_preempted(self, batch: list[tuple]) -> None:
        """End the wave without its results if a preempting write has come; its invocations are planned again."""
        if not self._preempting or self._preemptions >= PREEMPTIONS:
            return
        self._preemptions += 1
        for s, *_ in batch:
            self.state[s.name].stale = True
        raise _Preempted

    def _dirty(self, s: System) -> bool:
        st = self.state[s.name]
        return max((self.world.watermark.get(c, -1) for c in self._interest(s)), default=-1) > st.planned

    def _phase(self, phase: str, committed: int, once: bool = False) -> tuple[int, bool]:
        any_ran = False
        while True:
            batch = []
            for s in (s for s in self.systems if s.phase == phase):
                found = self._todo(s)
                if found is None:
                    continue
                rows, todo, n = found
                committed += n
                if self.commit_limit is not None and committed > self.commit_limit:
                    raise FactError(f"commit limit exceeded: {committed} invocations, {self.commit_limit} allowed")
                for callback in self._hooks["start"]:
                    callback(s.name)
                st, began = self.state[s.name], time.time()
                more = {"keep": self.storage.save} if s.keeps else {}
                batch.append((s, todo, n, list(s.body(rows, **self._views(s), **more) or ())))
                st.views = max((self.world.watermark.get(c, -1) for c in self._viewed(s)), default=-1)
                st.runs, st.waves, st.run_s = st.runs + n, st.waves + 1, st.run_s + time.time() - began
            self._check_preempted(batch)
            if not batch:
                return committed, any_ran
            any_ran = True
            self.counters["waves"] += 1
            self._waves += 1
            if self.wave_limit is not None and self._waves > self.wave_limit:
                raise FactError(f"wave limit exceeded: {self.wave_limit} allowed in one settle")
            self._apply(batch, settle=phase == "settle")
            for s, _, _, _ in batch:
                for callback in self._hooks["complete"]:
                    callback(s.name)
            if once:
                return committed, True

    def _views(self, s: System) -> dict[str, Any]:
        def of(q: Query | Meta) -> DataFrame:
            if isinstance(q, Meta):
                return self._current(q.component)
            return plan(self.world, self.registry, q).rows.select([f"`{c}`" for c in visible(q)])

        return {name: of(v) if isinstance(v, (Query, Meta)) else replace(v, **{k: of(q) for k, q in bundled(v).items()}) for name, v in s.views.items()}

    def _view_interest(self, q: Query) -> set[str]:
        found = {*q.reads(), *q.optional(), *(f.component for f in walk(q.where) if hasattr(f, "component"))}
        for shape in q.shapes():
            found |= self.registry.shapes[shape].parts
        return found

    def _apply(self, batch: list[tuple[System, DataFrame | None, int, list[Any]]], settle: bool = False) -> None:
        """One commit for all systems of a wave."""
        new: dict[str, list[DataFrame]] = {}
        gone: dict[str, list[DataFrame]] = {}
        dead: list[DataFrame] = []
        anchored: list[tuple[System, str, DataFrame, int | None]] = []
        swept: list[DataFrame] = []
        n_swept = 0
        held: dict[str, int] = {}
        unheld: set[str] = set()
        aged: set[str] = set()  # written to entities that may have been there before
        for s, todo, n, outputs in batch:
            first = todo is not None and self.state[s.name].waves == 1  # nothing of it is there to sweep
            keep = [o for o in outputs if not settle or isinstance(o, (Remove, Despawn))]
            if settle and len(keep) < len(outputs):  # inserts of this phase wait for the next settle
                self._late.append((s, [o for o in outputs if o not in keep]))
            for o in keep:
                if isinstance(o, Write):
                    self._conform(s, frozenset([o.component]), False)
                    new.setdefault(o.component, []).append(self._owned(s, o.rows.select("_keys", "entity", "value"), o.component))
                    unheld.add(o.component)
                    aged.add(o.component)
                elif isinstance(o, Spawn):
                    self._conform(s, frozenset(o.components), True)
                    slot = F.col(o.slot) if o.slot else F.lit(0)
                    entity = -F.shiftrightunsigned(F.xxhash64(F.lit(s.name), "_keys", slot.cast("string")), 2) - 1
                    rows = o.rows.withColumn("_entity", entity)
                    if not first:
                        aged |= {*o.components}
                    if len(o.components) + bool(o.anchors) > 1:  # the body is worked out once for all of them
                        rows, counts = self._held(rows.select("_keys", "_entity", *[F.col(f"`{c}`").cast(self.registry[c].type).alias(c) for c in o.components]), ["_keys", *o.components])
                        held |= {c: held.get(c, 0) + counts[c] for c in o.components}
                    else:
                        unheld |= {*o.components}
                    if o.anchors:
                        # one anchor a row, where nothing else has spawned the entity
                        anchored.append((s, o.anchors, rows.select("_keys", F.col("_entity").alias("entity")), counts["_keys"] if first else None))
                    for c in o.components:
                        new.setdefault(c, []).append(self._owned(s, rows.select("_keys", F.col("_entity").alias("entity"), F.col(f"`{c}`").alias("value")), c))
                elif isinstance(o, Remove):
                    gone.setdefault(o.component, []).append(o.rows.select("entity"))
                elif isinstance(o, Despawn):
                    dead.append(o.rows.select("entity"))
                else:
                    raise FactError(f"{s.name} gave {type(o).__name__}")
            if todo is not None:
                if not first:
                    swept.append(todo.select(F.lit(s.name).alias("_owner"), "_keys"))
                    n_swept += n
                st = self.state[s.name]
                st.memo = self._remember(st.memo, todo.select("_keys", "_deps"), n)
        owners = {s.name for s, t, _, _ in batch if t is not None and self.state[s.name].waves > 1}
        for s, _, _, outputs in batch:
            for c in (c for o in outputs for c in ([o.component] if isinstance(o, Write) else o.components if isinstance(o, Spawn) else [])):
                self._wrote.setdefault(c, set()).add(s.name)
        for s, c, _, _ in anchored:
            self._wrote.setdefault(c, set()).add(s.name)
        ran = reduce(DataFrame.union, swept) if swept else None
        over: dict[str, DataFrame] = {}
        if ran is not None:
            # only tables that these rules have written can hold outputs to sweep
            over = {name: ran for name in self.world.tables if owners & self._wrote.get(name, set())}
        before = self.revision
        self._commit({c: reduce(DataFrame.unionByName, d) for c, d in new.items()}, over, {c: reduce(DataFrame.union, d) for c, d in gone.items()}, reduce(DataFrame.union, dead) if dead else None, n_swept=n_swept, held={c: k for c, k in held.items() if c not in unheld}, fresh=frozenset(new) - aged)
        if anchored:
            self._anchor(anchored)
        self._absorb(batch, before)
        self._races(batch, before)

    def _races(self, batch: list[tuple[System, DataFrame | None, int, list[Any]]], before: int) -> None:
        """A rule whose views another of its wave has just changed has seen what is no more: it will be healed, but the order was not told."""
        wrote = {s.name: {c for o in outputs for c in ([o.component] if isinstance(o, (Write, Remove)) else o.components if isinstance(o, Spawn) else [])} for s, _, _, outputs in batch}
        for s, todo, _, _ in batch:
            if todo is None:
                continue
            for other, some in wrote.items():
                raced = sorted(c for c in some & self._viewed(s) if other != s.name and self.world.watermark.get(c, -1) > before)
                if raced:
                    said = f"{s.name} viewed {', '.join(raced)}, which {other} changed in the same wave"
                    if self.strict:
                        raise FactError(said)
                    if said not in self.warnings:
                        self.warnings.append(said)

    # -- provenance ------------------------------------------------------

    def _entity_revisions(self, entities: DataFrame) -> DataFrame:
        """entity, now: the highest revision of an entity's tracked components."""
        tables = [self.world.table(n) for n in sorted(self._tracked()) if not self.world.known_empty(n)]
        revs = [t.join(entities, "entity", "left_semi").select("entity", "_rev") for t in tables]
        return reduce(DataFrame.union, revs).groupBy("entity").agg(F.max("_rev").alias("now"))

    def _uniform(self, name: str) -> int | None:
        """The revision of every entity that has this component, if it is known to be the same for all of them.

        Of a table as it was spawned or loaded all rows have one revision, and what was spawned later is other entities;
        so only tables that were written since are looked at, for whether an entity of this one is there.
        """
        w, c = self.world, self.registry[name]
        if c.untracked or w.known_empty(name):
            return None
        births = w.births.get(name, ())
        rev = w.fused[name].rev if name in w.fused else births[0] if len(births) == 1 else None
        if rev is None and not c.singleton:
            return None
        # the reserved entities of singletons are none that rules spawn
        others = [n for n in sorted(self._tracked()) if n not in w.births and not (births and self.registry[n].singleton)]
        newer = [n for n in others if rev is None or n != name and w.watermark.get(n, -1) > rev]
        if not newer:
            return rev
        key = (name, rev, *((n, w.watermark.get(n, -1)) for n in newer))
        if key not in self._uniforms:
            if c.singleton:
                own = self.registry.singleton_entity(name)
                self._uniforms[key] = reduce(DataFrame.union, [w.table(n).where(F.col("entity") == own).select("_rev") for n in newer]).agg(F.max("_rev")).first()[0]
            else:
                moved = reduce(DataFrame.union, [w.table(n).where(F.col("_rev") > rev).select("entity") for n in newer])
                sizes = [w.tables[n].n if n in w.tables else -1 for n in newer]
                met = w.table(name).select("entity").join(small(moved, sum(sizes)) if min(sizes) >= 0 else moved, "entity", "left_semi")
                self._uniforms[key] = None if met.agg(F.count(F.lit(1))).first()[0] else rev
        return self._uniforms[key]

    def _uniforms_of(self, s: System) -> list[tuple[str, int]] | None:
        """For each parameter a component that its entities have and their revision, if all have one."""
        found = []
        for p in s.params:
            if isinstance(p, Maybe):
                return None
            q = query_of(p)
            b = bound(q.where)
            names = dict.fromkeys([*q.reads(), *b.keys, *(f.component for f in conjuncts(b.rest) if isinstance(f, (With, Eq, Gte)))])
            known = next(((c, rev) for c in sorted(names, key=lambda c: not self.registry[c].singleton) if (rev := self._uniform(c)) is not None), None)
            if known is None:
                return None
            found.append(known)
        return found

    def _anchor(self, anchored: list[tuple[System, str, DataFrame, int | None]]) -> None:
        """Note for spawned entities the entities that they come from, at the revisions after all writes of the wave."""
        new: dict[str, list[DataFrame]] = {}
        sizes: dict[str, int] = {}
        looked_up: set[str] = set()
        for s, component, rows, n in anchored:
            if not self.registry[component].provenance:
                raise FactError(f"{component} holds no provenance")
            known = self._uniforms_of(s) if n is not None else None
            if known is not None:  # nothing to look up
                came = F.array(*[F.struct(F.col("_keys")[i].alias("entity"), F.lit(rev).cast("long").alias("rev")) for i, (_, rev) in enumerate(known)])
                new.setdefault(component, []).append(rows.select("entity", F.array_sort(came).alias("value"), F.lit(s.name).alias("_owner"), "_keys"))
                sizes[component] = sizes.get(component, 0) + n
                self._sure.setdefault(component, set()).update(known)
                continue
            looked_up.add(component)
            each = self.storage.save(rows.distinct().select("entity", "_keys", F.explode("_keys").alias("_from")))
            now = self._entity_revisions(each.select(F.col("_from").alias("entity")).distinct())
            held = each.join(now.withColumnRenamed("entity", "_from"), "_from").groupBy("entity", "_keys").agg(F.array_sort(F.collect_list(F.struct(F.col("_from").alias("entity"), F.col("now").alias("rev")))).alias("value"))
            new.setdefault(component, []).append(held.select("entity", "value", F.lit(s.name).alias("_owner"), "_keys"))
        self._commit({c: reduce(DataFrame.unionByName, d) for c, d in new.items()}, {}, {}, None, held={c: k for c, k in sizes.items() if c not in looked_up}, fresh=frozenset(new) - looked_up)

    def _tracked(self) -> set[str]:
        return {n for n in {*self.world.tables, *self.world.fused} if not self.registry[n].untracked}

    def _current(self, component: str) -> DataFrame:
        """(entity, current): whether what each came from is as it was; no anchor at all is not current."""
        each = self.world.table(component).select("entity", F.explode_outer("value").alias("a")).select("entity", F.col("a.entity").alias("_from"), F.col("a.rev").alias("_was"))
        return self._as_it_was(each)

    def _as_it_was(self, each: DataFrame) -> DataFrame:
        now = self._entity_revisions(each.select(F.col("_from").alias("entity")).distinct()).withColumnRenamed("entity", "_from")
        return each.join(now, "_from", "left").groupBy("entity").agg(F.bool_and(F.coalesce(F.col("now") == F.col("_was"), F.lit(False))).alias("current"))

    def _clean(self) -> bool:
        """Remove entities of which an anchor has moved or gone; no anchor at all is not current either.

        Only anchors at entities that moved since the last time are looked at, and those written since.
        """
        stale = []
        for c in self.registry.components.values():
            if not c.provenance or c.name not in self.world.tables:
                continue
            high = max(self.world.watermark.values(), default=-1)
            last = self._cleaned.get(c.name, -1)
            if last == high:
                continue
            self._cleaned[c.name] = high
            if c.name in self.world.births and all(self._uniform(n) == rev for n, rev in self._sure.get(c.name, ())):
                continue  # whatever its entities came from is as it was
            held = self.world.table(c.name)
            each = held.select("entity", "_rev", F.explode_outer("value").alias("a")).select("entity", "_rev", F.col("a.entity").alias("_from"), F.col("a.rev").alias("_was"))
            if last >= 0:
                moved = self.world.moved(self._tracked(), last)
                near = each.where(F.col("_rev") > last)
                if moved is not None:
                    near = near.unionByName(each.join(moved.withColumnRenamed("entity", "_from"), "_from", "left_semi").where(F.col("_rev") <= last).select(each.columns))
                each = self.storage.save(near)
            stale.append(self._as_it_was(each.select("entity", "_from", "_was")).where("not current").select("entity"))
        if not stale:
            return False
        gone, seen = self.storage.counted(reduce(DataFrame.union, stale).distinct())
        return seen["n"] > 0 and self._commit({}, {}, {}, gone)

    def _absorb(self, batch: list[tuple[System, DataFrame | None, int, list[Any]]], before: int) -> None:
        """An invocation's write to a row that it reads is no news to it: its memo takes the revision that this write has given the row."""
        if self.revision == before:
            return
        for s, todo, n, outputs in batch:
            if todo is None:
                continue
            places: dict[tuple[int, str], int] = {}  # where the dependency on a component of a parameter is
            at = 0
            for i, (_, deps, _) in enumerate(self._params(s, self.world)):
                for d in deps:
                    places[i, d.removeprefix(f"p{i}._rev.")] = at
                    at += 1
            held, touched = todo, False
            for o in outputs:
                if not isinstance(o, Write) or self.world.watermark.get(o.component, -1) <= before:
                    continue
                for i in range(len(s.params)):
                    if (i, o.component) not in places:
                        continue
                    own = o.rows.where(F.col("entity") == F.col("_keys")[i]).select("_keys").distinct().withColumnRenamed("_keys", "_wk")
                    revs = self.world.table(o.component).where(F.col("_rev") > before).select(F.col("entity").alias("_we"), F.col("_rev").alias("_wr"))
                    p = places[i, o.component]
                    met = held.join(own, F.col("_keys") == F.col("_wk"), "left").join(revs, F.col("_wk")[i] == F.col("_we"), "left")
                    renewed = F.concat(F.slice("_deps", 1, p), F.array("_wr"), F.slice("_deps", p + 2, 64))
                    held = met.select("_keys", F.when(F.col("_wr").isNull(), F.col("_deps")).otherwise(renewed).alias("_deps"))
                    touched = True
            if touched:
                st = self.state[s.name]
                st.memo = self._remember(st.memo, self.storage.save(held), n)

    def _conform(self, s: System, written: frozenset[str], spawned: bool) -> None:
        if s.outputs and not written <= set(s.outputs):
            raise FactError(f"{s.name} writes {sorted(written - set(s.outputs))}, which it did not declare")
        if not self.registry.conforms(written, spawned):
            raise FactError(f"{s.name}: {sorted(written)} fit no shape")

    def _owned(self, s: System, rows: DataFrame, component: str) -> DataFrame:
        c = self.registry[component]
        if isinstance(c, Inverse):
            raise FactError(f"{component} is kept by the store")
        entity = F.lit(self.registry.singleton_entity(component)) if c.singleton else F.col("entity").cast("long")
        return rows.select(entity.alias("entity"), F.col("value").cast(c.type).alias("value"), F.lit(s.name).alias("_owner"), "_keys").where("value is not null and entity is not null")

    def _heal(self) -> bool:
        """Rules whose views moved after they ran forget their memo and run again."""
        healed = False
        for s in self.systems:
            st = self.state[s.name]
            if not s.views or st.memo is None or st.waves == 0 or s.phase == "settle":
                continue
            now = max((self.world.watermark.get(c, -1) for c in self._viewed(s)), default=-1)
            if now > st.views:
                st.heals += 1
                if st.heals > HEAL_LIMIT:
                    raise FactError(f"{s.name} was healed over {HEAL_LIMIT} times in one settle")
                st.memo, st.stale, healed = None, True, True
        return healed

    # -- reads -----------------------------------------------------------

    def _read(self, world: World, q: Query | Named, args: dict[str, Any], scoped: dict[str, dict[str, Any]]) -> DataFrame:
        named = isinstance(q, Named)
        own = {**args, **scoped.get(q.tag, {})} if named else args
        query = q.query if named else q
        return plan(world, self.registry, query, own).rows.select([f"`{c}`" for c in visible(query)])

    def read(self, *queries: Query | Named, args_for: dict[str, dict[str, Any]] | None = None, **args: Any) -> Any:
        """Settle, then the query's rows; several queries give a list of independent results of one version."""
        self.settle()
        found = [self._read(self.settled, q, args, args_for or {}) for q in queries]
        return found[0] if len(found) == 1 else found

    def last_settled(self, *queries: Query | Named, args_for: dict[str, dict[str, Any]] | None = None, **args: Any) -> Any:
        """Rows of the last settled version, without running anything."""
        found = [self._read(self.settled, q, args, args_for or {}) for q in queries]
        return found[0] if len(found) == 1 else found

    def changed_since(self, q: Query, cursor: int, **args: Any) -> DataFrame:
        """Rows of which something that the query reads has changed after the cursor."""
        self.settle()
        p = plan(self.settled, self.registry, q, args)
        parts = [c for c in dict.fromkeys([*p.required, *p.optional, *p.tracked]) if not self.registry[c].untracked]
        return p.rows.where(joins.greatest_of([f"_rev.{c}" for c in parts]) > cursor).select([f"`{c}`" for c in visible(q)])

    def drain(self, q: Query, **args: Any) -> DataFrame:
        """The query's rows, and their entities are gone after it."""
        with self._lock:
            found = self.storage.save(self.read(q, **args))
            self.despawn(found.select("entity"))
            self.settle()
            return found

    @contextmanager
    def request(self, entity: int, **values: Any):
        """Put a request; ``take`` in the block reads responses and removes them, and all goes with the block."""
        self.put(entity, **values)
        r = Request(self, entity)
        try:
            yield r
        finally:
            self.despawn([entity])
            self.settle()

    def vacuum(self) -> int:
        """Delete what superseded versions have written; how many tables.  DataFrames read from older versions can't be used afterwards."""
        with self._lock:
            held = [t.rows() for t in [*self.world.tables.values(), *self.settled.tables.values()]]
            held += [st.memo.rows() for st in self.state.values() if st.memo is not None]
            held += [gone for some in self.world.lost.values() for _, gone in some] + [k for st in self.state.values() for k in st.forgotten]
            if self._queue or self._late:
                return 0  # what waits may be made from any of them
            return self.storage.sweep({f for df in held for f in df.inputFiles()})

    def close(self) -> None:
        """Delete all that the store wrote; its DataFrames can't be read afterwards."""
        self.storage.clear()

    # -- reports ---------------------------------------------------------

    def explain(self, suffix: str) -> dict[str, Any] | None:
        """Of the system whose name ends so: phase, matched and memoized rows, and whether its views moved since it ran."""
        for s in self.systems:
            if s.name.endswith(suffix):
                st = self.state[s.name]
                now = max((self.world.watermark.get(c, -1) for c in self._viewed(s)), default=-1)
                return {"name": s.name, "phase": s.phase, "matched": self._plan(s, self.world, None).count(), "memoized": 0 if st.memo is None else st.memo.rows().count(), "stale_views": bool(s.views) and now > st.views}
        return None

    def explain_all(self) -> list[dict[str, Any]]:
        return [self.explain(s.name) for s in self.systems]

    def profile(self) -> dict[str, dict[str, float]]:
        """Invocations, waves and seconds by system."""
        return {n: {"runs": st.runs, "waves": st.waves, "plan_s": st.plan_s, "run_s": st.run_s} for n, st in self.state.items()}


class Request:
    def __init__(self, engine: Engine, entity: int):
        self.engine, self.entity = engine, entity

    def take(self, *components: str, optional: tuple[str, ...] = ()) -> Any:
        """Values of the request's entity; a missing one is an error that names it, unless optional."""
        e = self.engine
        e.settle()
        found = []
        for name in (*components, *optional):
            row = e.settled.table(name).where(F.col("entity") == self.entity).select("value").first()
            if row is None and name not in optional:
                raise FactError(f"no response: {name} is missing")
            found.append(None if row is None else row[0])
        e.despawn([self.entity])
        return found[0] if len(found) == 1 else tuple(found)

