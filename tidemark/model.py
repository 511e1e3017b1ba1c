"""Components, shapes and their registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities that rules spawn are negative, so that they never meet natural keys.
MOST_PARTS = 12


class FactError(ValueError):
    """A declaration, query or write that the store refuses."""


@dataclass(frozen=True)
class Component:
    """A table of one value an entity.

    ``type`` is the Spark type of the value (``boolean`` for a tag, which is
    present or not; a null is never a value).  How a write counts as a change:
    with ``hash`` if the value differs, with ``revision`` if that field of a
    struct differs, else always; with ``untracked`` it never counts for readers.
    ``target`` makes it an edge whose value, or that field of it, is an entity;
    ``singleton`` keeps all values on one reserved entity; ``provenance`` holds
    what an entity was derived from.
    """

    name: str
    type: str = "boolean"
    hash: bool = False
    revision: str | None = None
    untracked: bool = False
    target: str | None = None
    singleton: bool = False
    provenance: bool = False
    on_insert: Callable[[DataFrame], None] | None = None
    on_remove: Callable[[DataFrame], None] | None = None
    on_entity_remove: Callable[[DataFrame], None] | None = None

    def __post_init__(self) -> None:
        if self.hash and self.revision:
            raise FactError(f"{self.name}: hash and revision exclude each other")
        if self.provenance:
            object.__setattr__(self, "type", "array<struct<entity:bigint,rev:bigint>>")
            object.__setattr__(self, "untracked", True)

    @property
    def fingerprinted(self) -> bool:
        return self.hash or self.revision is not None

    def fingerprint(self, value: Column) -> Column:
        if self.revision:
            return value[self.revision].cast("long")
        return F.xxhash64(value) if self.hash else F.lit(None).cast("long")

    def print_sql(self, value: str) -> str:
        """The fingerprint as SQL over that of a value: one expression to send instead of many calls."""
        if self.revision:
            return f"CAST({value}.`{self.revision}` AS BIGINT)"
        return f"xxhash64({value})" if self.hash else "CAST(NULL AS BIGINT)"

    def target_of(self, value: Column) -> Column:
        return value if self.target == "value" else value[self.target]


@dataclass(frozen=True)
class Inverse(Component):
    """For each target of ``edge`` the sorted list of entities that point at it; kept by the store, always hashed.

    Without ``lists`` it only holds how many there are and a digest of the set:
    enough for rules that join its members, which go along the edges, and the
    form to choose where a target may have very many.
    """

    edge: str = ""
    lists: bool = True

    def __post_init__(self) -> None:
        if self.hash or self.revision:
            raise FactError(f"{self.name}: an inverse has a fingerprint of its own")
        if self.target:
            raise FactError(f"{self.name}: an inverse cannot be an edge too")
        object.__setattr__(self, "hash", True)
        object.__setattr__(self, "type", "array<bigint>" if self.lists else "struct<n:bigint,digest:bigint>")


@dataclass(frozen=True)
class Shape:
    """What an entity of a kind has: required components and optional ones."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if len(self.required) + len(self.optional) > MOST_PARTS:
            raise FactError(f"{self.name}: {len(self.required) + len(self.optional)} parts, {MOST_PARTS} at most")

    @property
    def parts(self) -> frozenset[str]:
        return frozenset(self.required) | frozenset(self.optional)


@dataclass
class Plugin:
    """Components, shapes and systems that come together."""

    components: Iterable[Component] = ()
    shapes: Iterable[Shape] = ()
    systems: Iterable = ()


@dataclass
class Registry:
    components: dict[str, Component] = field(default_factory=dict)
    shapes: dict[str, Shape] = field(default_factory=dict)

    def add(self, components: Iterable[Component], shapes: Iterable[Shape]) -> None:
        for c in components:
            if self.components.setdefault(c.name, c) != c:
                raise FactError(f"{c.name} is declared twice, differently")
        for s in shapes:
            if self.shapes.setdefault(s.name, s) != s:
                raise FactError(f"shape {s.name} is declared twice, differently")

    def check(self) -> None:
        for s in self.shapes.values():
            for part in s.parts - self.components.keys():
                raise FactError(f"shape {s.name}: no component {part}")
        for c in self.components.values():
            if isinstance(c, Inverse) and (c.edge not in self.components or not self.components[c.edge].target):
                raise FactError(f"{c.name}: {c.edge} is no edge")

    def __getitem__(self, name: str) -> Component:
        if name not in self.components:
            raise FactError(f"no component {name}")
        return self.components[name]

    def inverses(self, edge: str) -> list[Inverse]:
        return [c for c in self.components.values() if isinstance(c, Inverse) and c.edge == edge]

    def conforms(self, written: frozenset[str], spawned: bool) -> bool:
        """A spawn must be one shape with all that it requires; writes to an entity that is there must fit in one shape."""
        if not self.shapes:
            return True
        return any(written <= s.parts and (not spawned or set(s.required) <= written) for s in self.shapes.values())

    def singleton_entity(self, name: str) -> int:
        """A reserved entity for each singleton, the same in every session."""
        return -(2**62) - sum(ord(c) * 257**i for i, c in enumerate(name)) % 2**61
