"""Scenarios of rules that settle: values and how often rules ran."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import threading
from dataclasses import dataclass
from typing import Any

from tidemark import (And, Component, Despawn, Engine, Entity, Eq, FactError, Gte, In, Inverse, Maybe, Meta, Mut, Named, Not, Optional, Or, Plugin, Query, Read, Remove, Shape, Spawn, Tracked, With, Without, Write, system)

A, B, C = (Component(n, "int") for n in ("A", "B", "C"))
H = Component("H", "int", hash=True)
Key, KeyB = Component("Key", "int", hash=True), Component("KeyB", "int", hash=True)
Sum = Component("Sum", "int")
Note = Component("Note")
Label = Component("Label", "string", hash=True)
Rank = Component("Rank", "int")
From = Component("From", provenance=True)
MemberOf = Component("MemberOf", "long", hash=True, target="value")
Members = Inverse("Members", "array<long>", edge="MemberOf")
ALL = [A, B, C, H, Key, KeyB, Sum, Note, Label, Rank, From, MemberOf, Members]


def values(df, column):
    return sorted(r[column] for r in df.select(f"`{column}`").collect())


def put(e, entity, **v):
    e.put(entity, **v)


def derive(spark_expr, source, target, name="derive"):
    @system(name, Query(Entity(), source), outputs=[target])
    def body(rows):
        yield Write(target, rows.select("_keys", F.col("`p0.entity`").alias("entity"), spark_expr.alias("value")))

    return body


def plus_one(source="A", target="B"):
    return derive(F.col(f"`p0.{source}`") + 1, source, target)


def joined(name="join", where=None):
    where = where or Eq("Key")

    @system(name, Query(Entity(), "A", "Key"), Query(Entity(), "B", where=where), outputs=["Sum"])
    def body(rows):
        yield Spawn(rows.select("_keys", (F.col("`p0.A`") * 100 + F.col("`p1.B`")).alias("Sum")), ("Sum",))

    return body


def test_derive_and_incremental_runs(spark):
    e = Engine(spark, ALL, systems=[plus_one()])
    put(e, 1, A=41)
    assert values(e.read(Query(Entity(), "B")), "B") == [42]
    put(e, 2, A=1)
    assert values(e.read(Query(Entity(), "B")), "B") == [2, 42]
    assert e.profile()["derive"]["runs"] == 2
    e.settle()
    assert e.profile()["derive"]["runs"] == 2


def test_no_op_settle_starts_no_job(spark):
    e = Engine(spark, ALL, systems=[plus_one()])
    put(e, 1, A=1)
    e.settle()
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quiet", "nothing to do")
    e.settle()
    assert not seen.getJobIdsForGroup("quiet")
    spark.sparkContext.setJobGroup("", "")


def test_filters_and_arguments(spark):
    e = Engine(spark, ALL)
    for i, (label, rank) in enumerate([("main", 1), ("main", 3), ("lib", 4)], 1):
        put(e, i, Label=label, Rank=rank, C=i)
    put(e, 4, C=9)
    q = Query(Entity(), "C", where=And(Eq("Label"), Gte("Rank")))
    assert values(e.read(q, Label="main", Rank=2), "C") == [2]
    assert values(e.read(Query("C", where=Not(Eq("Label", "main")))), "C") == [3, 9]
    assert values(e.read(Query("C", where=Or(Eq("Label", "lib"), Without("Label")))), "C") == [3, 9]
    assert values(e.read(Query("C", where=With("Label"))), "C") == [1, 2, 3]
    with pytest.raises(FactError, match="no argument"):
        e.read(q, Label="main")
    both = e.read(Query("C"), Query("C", where=Eq("Label")), Label="main")
    assert [d.count() for d in both] == [4, 2]
    named = e.read(Named("x", Query("C", where=Eq("Label"))), Named("y", Query("C", where=Eq("Label"))), args_for={"x": {"Label": "main"}, "y": {"Label": "lib"}})
    assert [values(d, "C") for d in named] == [[1, 2], [3]]
    rows = {r.entity: r.Label for r in e.read(Query(Entity(), "C", Optional("Label"))).collect()}
    assert rows == {1: "main", 2: "main", 3: "lib", 4: None}
    assert e.read(Query(Entity())).count() == 4


def test_equality_join_counts_pairs(spark):
    e = Engine(spark, ALL, systems=[joined()])
    put(e, 1, A=1, Key=1)
    put(e, 2, A=2, Key=2)
    for i, (b, k) in enumerate([(10, 1), (20, 1), (30, 2)], 10):
        put(e, i, B=b, Key=k)
    q = Query("Sum")
    assert values(e.read(q), "Sum") == [110, 120, 230]
    assert e.profile()["join"]["runs"] == 3
    e.settle()
    assert e.profile()["join"]["runs"] == 3
    put(e, 20, B=40, Key=1)
    assert values(e.read(q), "Sum") == [110, 120, 140, 230]
    assert e.profile()["join"]["runs"] == 4
    put(e, 12, B=31)
    assert values(e.read(q), "Sum") == [110, 120, 140, 231]
    assert e.profile()["join"]["runs"] == 5


def test_removed_partner_retires_the_pair(spark):
    e = Engine(spark, ALL, systems=[joined()])
    put(e, 1, A=1, Key=1)
    put(e, 10, B=10, Key=1)
    assert values(e.read(Query("Sum")), "Sum") == [110]
    e.despawn([10])
    assert values(e.read(Query("Sum")), "Sum") == []


def test_self_keyed_join_keeps_self_pairs(spark):
    @system("self", Query(Entity(), "A", "Key"), Query(Entity(), "B", where=Eq("Key")))
    def body(rows):
        yield Spawn(rows.select("_keys", (F.col("`p0.A`") * 1000 + F.col("`p1.B`")).alias("Sum")), ("Sum",))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=1, Key=1, B=21)
    put(e, 3, B=3, Key=9)
    assert values(e.read(Query("Sum")), "Sum") == [1021]


def test_compound_join(spark):
    @system("pair", Query(Entity(), "A", "Key", "KeyB"), Query(Entity(), "B", where=And(Eq("Key"), Eq("KeyB"))))
    def body(rows):
        yield Spawn(rows.select("_keys", (F.col("`p0.A`") + F.col("`p1.B`")).alias("Sum")), ("Sum",))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=100, Key=1, KeyB=1)
    put(e, 2, A=200, Key=1, KeyB=2)
    for i, (b, k, kb) in enumerate([(10, 1, 1), (20, 1, 2), (30, 2, 1)], 10):
        put(e, i, B=b, Key=k, KeyB=kb)
    assert values(e.read(Query("Sum")), "Sum") == [110, 220]


def test_product_and_gate(spark):
    @system("product", Query(Entity(), "A"), Query(Entity(), "B"))
    def body(rows):
        yield Spawn(rows.select("_keys", (F.col("`p0.A`") + F.col("`p1.B`")).alias("Sum")), ("Sum",))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=2)
    assert e.read(Query("Sum")).isEmpty()
    put(e, 2, B=3)
    put(e, 3, B=4)
    assert values(e.read(Query("Sum")), "Sum") == [5, 6]


def test_outer_join_and_late_partner(spark):
    @system("outer", Query(Entity(), "A", "Key"), Maybe(Query(Entity(), "B", where=Eq("Key"))), outputs=["Sum"])
    def body(rows):
        yield Spawn(rows.select("_keys", F.coalesce(F.col("`p1.B`"), F.lit(999)).alias("Sum")), ("Sum",))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=1, Key=1)
    put(e, 2, A=2, Key=2)
    put(e, 10, B=42, Key=1)
    assert values(e.read(Query("Sum")), "Sum") == [42, 999]
    put(e, 11, B=7, Key=2)
    assert 7 in values(e.read(Query("Sum")), "Sum")


def test_membership_join_and_inverse(spark):
    @system("in", Query(Entity(), "A", "Members"), Query(Entity(), "B", where=In("Members")))
    def body(rows):
        yield Spawn(rows.select("_keys", F.col("`p0.A`").bitwiseXOR(F.col("`p1.B`")).alias("Sum")), ("Sum",))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=8)
    put(e, 2, A=16)
    put(e, 10, B=1, MemberOf=1)
    put(e, 11, B=2, MemberOf=1)
    members = lambda: {r.entity: r.Members for r in e.read(Query(Entity(), "Members")).collect()}
    assert members() == {1: [10, 11]}
    assert values(e.read(Query("Sum")), "Sum") == [9, 10]
    put(e, 11, MemberOf=2)
    assert members() == {1: [10], 2: [11]}
    e.remove("MemberOf", [10])
    assert members() == {2: [11]}
    e.despawn([2])
    assert members() == {}
    assert e.read(Query("MemberOf")).isEmpty()


def test_cutoff_by_fingerprint(spark):
    plain = Engine(spark, ALL, systems=[plus_one()])
    put(plain, 1, A=1)
    plain.settle()
    put(plain, 1, A=1)
    plain.settle()
    assert plain.profile()["derive"]["runs"] == 2  # without a fingerprint every write is a change
    e = Engine(spark, ALL, systems=[derive(F.col("`p0.H`") % 2, "H", "Key", "parity"), derive(F.col("`p0.Key`") + 1, "Key", "B", "next")])
    put(e, 1, H=2)
    e.settle()
    put(e, 1, H=4)
    e.settle()
    p = e.profile()
    assert (p["parity"]["runs"], p["next"]["runs"]) == (2, 1)
    put(e, 1, H=4)
    e.settle()
    assert e.profile()["parity"]["runs"] == 2


def test_outputs_not_given_again_are_swept(spark):
    @system("odd", Query(Entity(), "A"), outputs=["B"])
    def body(rows):
        yield Write("B", rows.where(F.col("`p0.A`") % 2 == 1).select("_keys", F.col("`p0.entity`").alias("entity"), F.col("`p0.A`").alias("value")))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=1)
    put(e, 2, A=3)
    assert values(e.read(Query("B")), "B") == [1, 3]
    put(e, 1, A=2)
    assert values(e.read(Query("B")), "B") == [3]


def test_provenance_cleanup(spark):
    @system("spawn", Query(Entity(), "A", where=With("Note")))
    def body(rows):
        yield Spawn(rows.select("_keys", F.col("`p0.A`").alias("B")), ("B",), anchors="From")

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=5, Note=True)
    assert values(e.read(Query("B")), "B") == [5]
    e.remove("Note", [1])
    assert values(e.read(Query("B")), "B") == [5]  # the row is gone, its output lingers
    put(e, 1, A=6)
    assert values(e.read(Query("B")), "B") == []


def test_singletons(spark):
    one = Component("Config", "int", singleton=True)
    e = Engine(spark, [*ALL, one, Component("Other", "int", singleton=True)])
    e.put(Config=1)
    e.put(Config=2)
    assert values(e.read(Query("Config")), "Config") == [2]
    with pytest.raises(FactError, match="singleton"):
        e.put(Config=1, Other=2)


def test_update_and_compare_and_set(spark):
    e = Engine(spark, ALL)
    put(e, 1, A=1, Label="x")
    put(e, 2, A=5, Label="y")
    e.update("A", F.col("value") * 10, where=Eq("Label"), Label="y")
    assert values(e.read(Query("A")), "A") == [1, 50]
    seen = e.revision_of(1, "A")
    assert e.compare_and_set(1, "A", 2)
    assert not e.compare_and_set(1, "A", 3, seen)
    assert values(e.read(Query("A")), "A") == [2, 50]
    assert e.with_latest(2, "A", lambda v: v + 1) == 51 and e.with_latest(9, "A", lambda v: v) is None
    assert values(e.read(Query("A")), "A") == [2, 51]


def test_cursor_drain_and_last_settled(spark):
    e = Engine(spark, ALL)
    for i in (1, 2):
        put(e, i, C=i, Note=True)
    put(e, 3, C=3)
    cursor = e.settle()
    put(e, 2, C=20)
    assert values(e.last_settled(Query("C")), "C") == [1, 2, 3]
    assert values(e.changed_since(Query(Entity(), "C"), cursor), "C") == [20]
    assert e.changed_since(Query("C"), e.settled_revision).isEmpty()
    assert values(e.drain(Query(Entity(), "C", where=With("Note"))), "C") == [1, 20]
    assert values(e.read(Query("C")), "C") == [3]


def test_phases_hooks_and_settle_phase(spark):
    log = []

    def logged(name, phase):
        @system(name, Query(Entity(), "A"), phase=phase)
        def body(rows):
            log.append(name)
            return ()

        return body

    @system("reap", Query(Entity(), "A"), phase="settle")
    def reap(rows):
        at = rows.select("_keys", F.col("`p0.entity`").alias("entity"))
        yield Remove("Note", at)
        yield Write("B", at.withColumn("value", F.lit(7)))

    e = Engine(spark, ALL, systems=[logged("complete", "complete"), logged("evaluate", "evaluate"), logged("startup", "startup"), reap])
    seen = []
    e.on("start", seen.append)
    e.next_settle(lambda rev: seen.append("settled"))
    put(e, 1, A=1, Note=True)
    e.settle()
    assert log == ["startup", "evaluate", "complete"]
    assert e.last_settled(Query("Note")).isEmpty() and e.last_settled(Query("B")).isEmpty()
    put(e, 2, C=1)
    assert values(e.read(Query("B")), "B") == [7]
    assert seen[-1] == "settled"


def test_commit_limit(spark):
    @system("grow", Query(Entity(), "A"))
    def body(rows):
        yield Spawn(rows.select("_keys", (F.col("`p0.A`") + 1).alias("A")), ("A",))

    assert Engine(spark).commit_limit == 10_000
    e = Engine(spark, ALL, systems=[body], commit_limit=2)
    put(e, 1, A=1)
    with pytest.raises(FactError, match="commit limit exceeded"):
        e.settle()
    assert e.last_settled(Query("A")).isEmpty()


def test_a_settle_that_fails_keeps_its_inputs(spark):
    e = Engine(spark, ALL, systems=[plus_one()], commit_limit=2)
    e.insert(A=spark.range(5).selectExpr("id AS entity", "cast(id AS int) AS value"))
    for _ in range(2):
        with pytest.raises(FactError, match="commit limit exceeded"):
            e.settle()
    assert e.last_settled(Query("A")).isEmpty()
    e.commit_limit = None
    assert values(e.read(Query("B")), "B") == [1, 2, 3, 4, 5] and e.profile()["derive"]["runs"] == 5


def test_views_heal(spark):
    @system("count", Query(Entity(), "Note"), views={"all": Query(Entity(), "B")}, outputs=["C"])
    def body(rows, all):
        n = all.agg(F.count("*").cast("int").alias("value"))
        yield Write("C", rows.select("_keys", F.col("`p0.entity`").alias("entity")).crossJoin(n))

    e = Engine(spark, ALL, systems=[body, plus_one()])
    put(e, 9, Note=True)
    put(e, 1, A=1)
    put(e, 2, A=1)
    assert values(e.read(Query("C")), "C") == [2]


def test_tracked_shape_and_facets(spark):
    wide = Shape("wide", ("Note", "C"), ("B",))
    ran = []

    @system("watch", Query(Entity("wide"), Tracked("wide")))
    def body(rows):
        ran.append(rows.count())
        return ()

    e = Engine(spark, ALL, [wide], [body])
    put(e, 1, Note=True, C=1, B=1)
    put(e, 2, Note=True, C=1)
    put(e, 3, Note=True)
    assert e.read(Query(Entity("wide"))).count() == 2
    put(e, 2, B=5)
    e.settle()
    put(e, 1, B=6)
    e.settle()
    assert ran == [2, 1, 1]


def test_recursive_fixed_point(spark):
    """Labels down a tree: a rule reads what it writes, through membership joins."""
    label = Component("Path", "string", hash=True)

    @system("label", Query(Entity(), "Path", "Members"), Query(Entity(), "Label", where=In("Members")), outputs=["Path"])
    def body(rows):
        yield Write("Path", rows.select("_keys", F.col("`p1.entity`").alias("entity"), F.concat_ws("/", "`p0.Path`", "`p1.Label`").alias("value")))

    e = Engine(spark, [*ALL, label], systems=[body])
    put(e, 1, Label="a", Path="a")
    put(e, 2, Label="b", MemberOf=1)
    put(e, 3, Label="c", MemberOf=2)
    put(e, 4, Label="d", MemberOf=3)
    assert values(e.read(Query("Path")), "Path") == ["a", "a/b", "a/b/c", "a/b/c/d"]
    put(e, 1, Path="z")
    assert values(e.read(Query("Path")), "Path") == ["z", "z/b", "z/b/c", "z/b/c/d"]


def test_request(spark):
    @system("answer", Query(Entity(), "Note", "A"), outputs=["B"])
    def body(rows):
        yield Write("B", rows.select("_keys", F.col("`p0.entity`").alias("entity"), (F.col("`p0.A`") * 2).alias("value")))

    e = Engine(spark, ALL, systems=[body])
    with e.request(50, Note=True, A=21) as r:
        assert r.take("B", optional=("C",)) == (42, None)
    assert e.read(Query(Entity())).isEmpty()
    with pytest.raises(FactError, match="C is missing"), e.request(51, Note=True, A=1) as r:
        r.take("C")
    assert e.read(Query(Entity())).isEmpty()


def test_own_write_is_no_news(spark):
    @system("bump", Query(Entity(), "A"), outputs=["A"])
    def body(rows):
        yield Write("A", rows.select("_keys", F.col("`p0.entity`").alias("entity"), (F.col("`p0.A`") + 1).alias("value")))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=1)
    assert values(e.read(Query("A")), "A") == [2]
    assert e.profile()["bump"]["runs"] == 1


def test_declaration_errors(spark):
    none = lambda rows: ()
    for params, what in [
        ((Query("A"), Query("B", where=Eq("Key"))), "0 providers"),
        ((Query("A", "Key"), Query("C", "Key"), Query("B", where=Eq("Key"))), "2 providers"),
        ((Query("A"), Query("B", where=Eq("A"))), "no fingerprint"),
        ((Query("A", "Key"), Maybe(Query("B"))), "outer"),
    ]:
        with pytest.raises(FactError, match=what):
            Engine(spark, ALL, systems=[system("s", *params)(none)])
    with pytest.raises(FactError, match="view"):
        Engine(spark, ALL, systems=[system("s", Query("A"), views={"v": Query("B", where=Eq("Key"))})(none)])
    with pytest.raises(FactError, match="exclude"):
        Component("X", "struct<revision:long>", hash=True, revision="revision")
    with pytest.raises(FactError, match="12 at most"):
        Shape("s", tuple(f"c{i}" for i in range(13)))
    with pytest.raises(FactError, match="fit no shape"):
        e = Engine(spark, ALL, [Shape("s", ("A", "B"))], [joined()])
        put(e, 1, A=1, Key=1)
        put(e, 2, B=1, Key=1)
        e.settle()
    late = Engine(spark, ALL, systems=[system("a", Query("A"), views={"v": Query("B")})(none), plus_one()])
    assert late.warnings


def test_plugins_explain_and_lifecycle(spark):
    seen = []
    hooked = Component("Hooked", "int", on_insert=lambda d: seen.append(("in", d.count())), on_remove=lambda d: seen.append(("out", d.count())), on_entity_remove=lambda d: seen.append(("gone", d.count())))
    e = Engine(spark, plugins=[Plugin(ALL, (), [plus_one()]), Plugin([hooked])])
    put(e, 1, A=1, Hooked=1)
    e.settle()
    assert e.explain("derive") == {"name": "derive", "phase": "evaluate", "matched": 1, "memoized": 1, "stale_views": False}
    assert e.explain("none") is None and len(e.explain_all()) == 1
    e.despawn([1])
    e.settle()
    assert seen == [("in", 1), ("gone", 1), ("out", 1)]
    assert e.read(Query(Entity())).isEmpty()


def test_despawn_by_rule(spark):
    @system("reaper", Query(Entity(), "A", where=With("Note")))
    def body(rows):
        yield Despawn(rows.select("_keys", F.col("`p0.entity`").alias("entity")))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=1, Note=True)
    put(e, 2, A=2)
    assert values(e.read(Query("A")), "A") == [2]


def test_incremental_equals_from_scratch(spark):
    rules = lambda: [plus_one(), joined(), derive(F.col("`p0.H`") % 3, "H", "Key", "third")]
    steps = [(i, {"A": i, "H": i * 7 % 5}) for i in range(1, 9)] + [(3, {"H": 2}), (4, {"A": 40}), (20, {"B": 3, "H": 1})]
    e = Engine(spark, ALL, systems=rules())
    for at in range(0, len(steps), 4):
        for entity, v in steps[at : at + 4]:
            put(e, entity, **v)
        e.settle()
    last: dict[int, dict] = {}
    for entity, v in steps:
        last.setdefault(entity, {}).update(v)
    whole = Engine(spark, ALL, systems=rules())
    for entity, v in last.items():
        put(whole, entity, **v)
    for c in ("B", "Key", "A"):
        assert values(e.read(Query(c)), c) == values(whole.read(Query(c)), c)


def test_writes_of_other_threads_are_the_next_epoch(spark):
    """A settle works on the writes that were there when it began; nobody waits for it to write."""
    inside, go_on = threading.Event(), threading.Event()

    @system("slow", Query(Entity(), "A"), outputs=["B"])
    def body(rows):
        inside.set()
        assert go_on.wait(60)
        yield Write("B", rows.select("_keys", F.col("`p0.entity`").alias("entity"), F.col("`p0.A`").alias("value")))

    e = Engine(spark, ALL, systems=[body])
    put(e, 1, A=1)
    runner = threading.Thread(target=e.settle)
    runner.start()
    assert inside.wait(60)
    put(e, 2, A=2)  # returns at once
    go_on.set()
    runner.join(120)
    assert e.profile()["slow"]["runs"] == 1 and values(e.last_settled(Query("B")), "B") == [1]
    assert values(e.read(Query("B")), "B") == [1, 2] and e.profile()["slow"]["runs"] == 2


def test_a_preempting_write_ends_the_wave(spark):
    inside, go_on, seen = threading.Event(), threading.Event(), []

    @system("begin", Query(Entity(), "A"), phase="startup")
    def begin(rows):
        seen.append("startup")
        return ()

    @system("slow", Query(Entity(), "A"), outputs=["B"])
    def body(rows):
        inside.set()
        assert go_on.wait(60)
        seen.append(values(rows, "p0.A"))
        yield Write("B", rows.select("_keys", F.col("`p0.entity`").alias("entity"), F.col("`p0.A`").alias("value")))

    e = Engine(spark, ALL, systems=[begin, body])
    put(e, 1, A=1)
    runner = threading.Thread(target=e.settle)
    runner.start()
    assert inside.wait(60)
    e.put(1, _preempt=True, A=7)
    go_on.set()
    runner.join(120)
    # what the first wave gave is dropped, the epoch goes on with the new value, through the startup phase again
    assert values(e.last_settled(Query("B")), "B") == [7] and e.counters["preemptions"] == 1
    assert seen == ["startup", [1], "startup", [7]]


def test_many_callers_one_runner(spark):
    e = Engine(spark, ALL, systems=[plus_one()])
    put(e, 1, A=1)
    threads = [threading.Thread(target=e.settle) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert e.profile()["derive"]["runs"] == 1 and e.counters["settles"] == 1


def test_new_entities_in_order(spark):
    e = Engine(spark, ALL)
    a, b = e.put(A=1), e.put(A=2)
    e.insert_rows(spark.range(100).selectExpr("cast(id AS int) AS n"), C="n")
    assert a < b and values(e.read(Query("A")), "A") == [1, 2]
    ids = values(e.read(Query(Entity(), "C")), "entity")
    assert len(set(ids)) == 100 and min(ids) > b


def test_mutation_with_a_partner(spark):
    """Of the pairs that would write one entity one runs in a wave; its own write is no news to it."""

    @system("raise", Query(Entity(), Mut("Key"), "Rank"), Query(Entity(), "C", where=Eq("Rank")), outputs=["Key"])
    def body(rows):
        yield Write("Key", rows.select("_keys", F.col("`p0.entity`").alias("entity"), F.greatest("`p0.Key`", "`p1.C`").alias("value")))

    ranked = [Component("Rank", "int", hash=True) if c.name == "Rank" else c for c in ALL]
    e = Engine(spark, ranked, systems=[body])
    put(e, 1, Key=3, Rank=1)
    for i, c in enumerate((5, 9, 4), 10):
        put(e, i, C=c, Rank=1)
    assert values(e.read(Query("Key")), "Key") == [9]
    assert e.profile()["raise"]["waves"] >= 3


def test_own_write_does_not_hide_what_others_wrote(spark):
    @system("own", Query(Entity(), Mut("A"), "H"), outputs=["A"])
    def own(rows):
        yield Write("A", rows.select("_keys", F.col("`p0.entity`").alias("entity"), (F.col("`p0.A`") + F.col("`p0.H`")).alias("value")))

    e = Engine(spark, ALL, systems=[own, derive(F.col("`p0.C`") * 10, "C", "H", "other")])
    put(e, 1, A=1, H=1, C=5)
    # own sees H = 1 while the other rule makes it 50 in the same wave: it runs once more
    assert values(e.read(Query("A")), "A") == [52] and e.profile()["own"]["runs"] == 2


def test_views_of_provenance_and_bundles(spark):
    @dataclass
    class Seen:
        notes: Any = Query(Entity(), "Note")
        ranks: Any = Query(Entity(), "Rank")

    got = []

    @system("spawn", Query(Entity(), "A"))
    def spawn(rows):
        yield Spawn(rows.select("_keys", F.col("`p0.A`").alias("B")), ("B",), anchors="From")

    @system("look", Query(Entity(), "C"), views={"seen": Seen(), "meta": Meta("From")}, phase="complete")
    def look(rows, seen, meta):
        got.append((seen.notes.count(), seen.ranks.count(), [r.current for r in meta.collect()]))
        return ()

    e = Engine(spark, ALL, systems=[spawn, look])
    put(e, 1, A=1, Note=True)
    put(e, 2, C=1, Rank=1)
    e.settle()
    assert got[-1] == (1, 1, [True])
    with pytest.raises(FactError, match="no provenance"):
        Engine(spark, ALL, systems=[system("s", Query("A"), views={"m": Meta("A")})(lambda rows, m: ())])


def test_races_in_a_wave_are_told(spark):
    def racing():
        @system("watch", Query(Entity(), "A"), views={"all": Query(Entity(), where=With("B"))})
        def watch(rows, all):
            all.count()
            return ()

        return [watch, plus_one()]

    e = Engine(spark, ALL, systems=racing())
    put(e, 1, A=1)
    e.settle()
    assert any("watch viewed B, which derive changed in the same wave" in w for w in e.warnings)
    strict = Engine(spark, ALL, systems=racing(), strict=True)
    put(strict, 1, A=1)
    with pytest.raises(FactError, match="same wave"):
        strict.settle()


def test_only_what_moved_is_planned(spark):
    """Optional and absent values, outer partners and removals: run counts, and results as from scratch."""

    @system("maybe", Query(Entity(), "A", Optional("C")), outputs=["B"])
    def maybe(rows):
        yield Write("B", rows.select("_keys", F.col("`p0.entity`").alias("entity"), (F.col("`p0.A`") + F.coalesce("`p0.C`", F.lit(0))).alias("value")))

    @system("without", Query(Entity(), "A", where=Without("Note")), outputs=["Rank"])
    def without(rows):
        yield Write("Rank", rows.select("_keys", F.col("`p0.entity`").alias("entity"), F.col("`p0.A`").alias("value")))

    @system("outer", Query(Entity(), "A", "Key"), Maybe(Query(Entity(), "H", where=Eq("Key"))))
    def outer(rows):
        yield Spawn(rows.select("_keys", F.coalesce("`p1.H`", F.lit(-1)).alias("Sum")), ("Sum",))

    e = Engine(spark, ALL, systems=[maybe, without, outer])
    for i in range(1, 5):
        put(e, i, A=i, Key=i)
    e.settle()
    runs = lambda: [e.profile()[n]["runs"] for n in ("maybe", "without", "outer")]
    assert runs() == [4, 4, 4]
    put(e, 2, C=10)
    assert sorted(values(e.read(Query("B")), "B")) == [1, 3, 4, 12] and runs() == [5, 4, 4]
    put(e, 3, Note=True)
    e.settle()
    assert runs() == [5, 4, 4]
    e.remove("Note", [3])
    e.settle()
    e.remove("C", [2])
    assert sorted(values(e.read(Query("B")), "B")) == [1, 2, 3, 4] and runs()[0] == 6
    put(e, 50, H=7, Key=4)
    assert 7 in values(e.read(Query("Sum")), "Sum") and runs()[2] == 5
    e.despawn([50])
    assert sorted(values(e.read(Query("Sum")), "Sum")).count(7) == 0 and runs()[2] == 6
    e.despawn([1])
    put(e, 4, A=40)
    assert sorted(values(e.read(Query("B")), "B")) == [2, 3, 40] and runs()[0] == 7


def test_a_gate_that_is_nowhere_costs_no_job(spark):
    @system("product", Query(Entity(), where=With("Note")), Query(Entity(), "A"))
    def body(rows):
        yield Spawn(rows.select("_keys", F.col("`p1.A`").alias("Sum")), ("Sum",))

    e = Engine(spark, ALL, systems=[body])
    e.settle()
    put(e, 1, A=1)
    e.settle()
    assert e.profile()["product"]["waves"] == 0 and e.state["product"].memo is None
    put(e, 9, Note=True)
    assert values(e.read(Query("Sum")), "Sum") == [1]


def test_removed_outputs_come_again(spark):
    """A pair that still holds gives again what was removed from outside."""
    e = Engine(spark, ALL, systems=[joined()])
    put(e, 1, A=1, Key=1)
    put(e, 10, B=5, Key=1)
    assert values(e.read(Query("Sum")), "Sum") == [105]
    at = [r.entity for r in e.read(Query(Entity(), "Sum")).collect()]
    e.remove("Sum", at)
    assert values(e.read(Query("Sum")), "Sum") == [105] and e.profile()["join"]["runs"] == 2
    put(e, 10, B=6)
    assert values(e.read(Query("Sum")), "Sum") == [106]


def test_vacuum(spark):
    e = Engine(spark, ALL, systems=[plus_one()])
    for i in range(4):
        put(e, 1, A=i)
        e.settle()
    assert e.vacuum() > 0 and values(e.read(Query("B")), "B") == [4]
    put(e, 1, A=9)
    assert values(e.read(Query("B")), "B") == [10]
