"""Query specifications, and how they become DataFrames.

A query reads parts of entities under a filter.  Parts that are required are
inner joins on the entity, optional ones left joins; parts of one physical
source are one scan.  Filters become predicates over left-joined columns, which
Catalyst turns back into inner, semi or anti joins where they demand presence.
Absence is a null column, and predicates are two-valued: an absent value is not
equal to anything, and the negation of that is true.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FactError, Registry

MOST_PARTS = 8


class Part:
    pass


@dataclass(frozen=True)
class Entity(Part):
    """The entity itself; with a shape, one that has all that the shape requires."""

    shape: str | None = None


@dataclass(frozen=True)
class Read(Part):
    component: str


@dataclass(frozen=True)
class Mut(Read):
    """A component that the rule reads and replaces: of the invocations that would write one entity, one runs in a wave, and its own write is no news to it."""


@dataclass(frozen=True)
class Optional(Part):
    component: str


@dataclass(frozen=True)
class Tracked(Part):
    """All of a shape's components as dependencies, none of them as columns."""

    shape: str


class Filter:
    pass


@dataclass(frozen=True)
class With(Filter):
    component: str


@dataclass(frozen=True)
class Without(Filter):
    component: str


_MISSING = object()


@dataclass(frozen=True)
class Eq(Filter):
    """The value equals the one given here or as an argument; in a rule, without either, that of the one other parameter that reads it."""

    component: str
    value: Any = _MISSING


@dataclass(frozen=True)
class Gte(Filter):
    component: str
    value: Any = _MISSING


@dataclass(frozen=True)
class In(Filter):
    """In a rule: the entity is in the list that the one other parameter reads."""

    component: str


@dataclass(frozen=True)
class And(Filter):
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Or(Filter):
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Not(Filter):
    filter: Filter


@dataclass(frozen=True)
class Query:
    parts: tuple[Part, ...]
    where: Filter | None = None

    def __init__(self, *parts: Part | str, where: Filter | None = None):
        object.__setattr__(self, "parts", tuple(Read(p) if isinstance(p, str) else p for p in parts))
        object.__setattr__(self, "where", where)
        if sum(not isinstance(p, Entity) for p in self.parts) > MOST_PARTS:
            raise FactError(f"{MOST_PARTS} parts at most")

    def reads(self) -> list[str]:
        return [p.component for p in self.parts if isinstance(p, Read)]

    def optional(self) -> list[str]:
        return [p.component for p in self.parts if isinstance(p, Optional)]

    def shapes(self) -> list[str]:
        return [p.shape for p in self.parts if isinstance(p, (Entity, Tracked)) and p.shape]


@dataclass(frozen=True)
class Maybe:
    """In a rule: an outer join; one row a match, else one row with nulls."""

    query: Query


@dataclass(frozen=True)
class Meta:
    """As a view: (entity, current) of the entities that hold this provenance component, and whether what each came from has stayed as it was.

    Such a rule runs once a generation whatever has changed.
    """

    component: str


@dataclass(frozen=True)
class Named:
    """A query with arguments of its own, which win over shared ones."""

    tag: str
    query: Query


@dataclass(frozen=True)
class Bound:
    """Keys that bind a parameter to others: component and whether by membership."""

    keys: tuple[str, ...] = ()
    members: str | None = None
    rest: Filter | None = field(default=None)


def walk(f: Filter | None) -> Iterator[Filter]:
    if f is not None:
        yield f
        for part in ("left", "right", "filter"):
            if isinstance(getattr(f, part, None), Filter):
                yield from walk(getattr(f, part))


def bound(f: Filter | None) -> Bound:
    """Split a rule's filter into what binds it to other parameters and the rest."""
    if isinstance(f, Eq) and f.value is _MISSING:
        return Bound((f.component,))
    if isinstance(f, In):
        return Bound(members=f.component)
    if isinstance(f, And):
        a, b = bound(f.left), bound(f.right)
        if a.members and b.members:
            raise FactError("one membership at most binds a parameter")
        rest = [x for x in (a.rest, b.rest) if x is not None]
        return Bound(a.keys + b.keys, a.members or b.members, reduce(And, rest) if rest else None)
    for inner in walk(f):
        if isinstance(inner, In) or isinstance(inner, Eq) and inner.value is _MISSING:
            raise FactError("keys bind a parameter only through And")
    return Bound(rest=f)


def predicate(f: Filter, value: dict[str, Column], args: dict[str, Any]) -> Column:
    """Two-valued: never null."""

    def argument(of: Eq | Gte) -> Any:
        if of.value is not _MISSING:
            return of.value
        if of.component not in args:
            raise FactError(f"no argument for {of.component}")
        return args[of.component]

    if isinstance(f, With):
        return value[f.component].isNotNull()
    if isinstance(f, Without):
        return value[f.component].isNull()
    if isinstance(f, Eq):
        return F.coalesce(value[f.component] == F.lit(argument(f)), F.lit(False))
    if isinstance(f, Gte):
        return F.coalesce(value[f.component] >= F.lit(argument(f)), F.lit(False))
    if isinstance(f, And):
        return predicate(f.left, value, args) & predicate(f.right, value, args)
    if isinstance(f, Or):
        return predicate(f.left, value, args) | predicate(f.right, value, args)
    if isinstance(f, Not):
        return ~predicate(f.filter, value, args)
    raise FactError(f"{type(f).__name__} is only for rules")


def conjuncts(f: Filter | None) -> Iterator[Filter]:
    if isinstance(f, And):
        yield from conjuncts(f.left)
        yield from conjuncts(f.right)
    elif f is not None:
        yield f


@dataclass
class Planned:
    """rows: entity, the values under their components' names, and ``_rev.<component>`` for each component looked at."""

    rows: DataFrame
    required: list[str]
    optional: list[str]
    tracked: list[str]
    filters: list[str]


def plan(world, registry: Registry, query: Query, args: dict[str, Any] | None = None, extra: tuple[str, ...] = ()) -> Planned:
    """Rows of a query on a world; ``extra`` are components to carry besides."""
    args = args or {}
    required = list(dict.fromkeys(query.reads()))
    for name in query.shapes():
        if name not in registry.shapes:
            raise FactError(f"no shape {name}")
        required += [c for c in registry.shapes[name].required if c not in required]
    optional = [c for c in dict.fromkeys(query.optional()) if c not in required]
    tracked = [c for p in query.parts if isinstance(p, Tracked) for c in sorted(registry.shapes[p.shape].parts)]
    optional += [c for c in tracked if c not in required and c not in optional]
    filters = [c for c in dict.fromkeys(f.component for f in walk(query.where) if hasattr(f, "component")) if c not in required]
    demanded = [f.component for f in conjuncts(query.where) if isinstance(f, (With, Eq, Gte)) and f.component in filters]
    extra = tuple(c for c in extra if c not in required)
    inner = list(dict.fromkeys([*required, *demanded, *extra]))
    outer = [c for c in dict.fromkeys([*optional, *filters]) if c not in inner]
    for c in [*inner, *outer]:
        registry[c]
    df = world.gather(inner, outer)
    columns = {c: F.col(f"`{c}`") for c in [*inner, *outer]}
    for part in conjuncts(query.where):
        held = predicate(part, columns, args)
        if isinstance(part, (Eq, Gte)):  # as a condition of its own a null is as good as false, and scans can be asked it
            value = args[part.component] if part.value is _MISSING else part.value
            held = columns[part.component] == F.lit(value) if isinstance(part, Eq) else columns[part.component] >= F.lit(value)
        df = df.where(held)
    return Planned(df, required, [c for c in optional if c in outer], tracked, filters)


def visible(query: Query) -> list[str]:
    return ["entity", *dict.fromkeys([*query.reads(), *query.optional()])]
