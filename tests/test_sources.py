"""Tables as components, plans, streams, scalar functions, the toy language."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark import Component, Engine, Entity, Eq, In, Inverse, Maybe, Optional, Query, Spawn, With, Write, from_table, ingest, system
from tidemark.functions.scalar import byte_length, first_line, lcg, word_at
from tidemark.workloads import language

PARTS = [Component("Name", "string", hash=True), Component("Size", "long", hash=True), Component("Group", "int", hash=True), Component("Out", "string", hash=True), Component("Sum", "long"), Component("In", "long", hash=True, target="value"), Inverse("Has", edge="In", lists=False)]


@pytest.fixture
def table(spark, tmp_path):
    spark.range(2000).selectExpr("id AS k", "concat('n', id % 7) AS name", "id * 2 AS size", "cast(id % 5 AS int) AS grp").write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_of_one_table_are_one_scan(spark, table):
    e = Engine(spark, PARTS)
    e.load(from_table(table, "k", Name="name", Size="size", Group="grp"))
    plan = plan_of(e.read(Query(Entity(), "Name", Optional("Size"), where=Eq("Group", 3))))
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert "EqualTo(grp,3)" in plan.replace(" ", "")
    narrow = plan_of(e.read(Query(Entity(), "Size")))
    assert "name" not in narrow.partition("ReadSchema")[2]


def test_membership_joins_by_equality(spark):
    @system("m", Query(Entity(), "Name", "Has"), Query(Entity(), "Size", where=In("Has")), outputs=["Out"])
    def body(rows):
        seen.append(plan_of(rows) + "".join(rows.columns))
        yield Write("Out", rows.select("_keys", F.col("`p1.entity`").alias("entity"), F.col("`p0.Name`").alias("value")))

    seen = []
    e = Engine(spark, PARTS, systems=[body])
    e.insert(Name=spark.createDataFrame([(1, "a"), (2, "b")], "entity long, value string"))
    e.insert(Size=spark.range(10, 40).selectExpr("id AS entity", "id AS value"), In=spark.range(10, 40).selectExpr("id AS entity", "1 + id % 2 AS value"))
    got = {r.entity: r.Out for r in e.read(Query(Entity(), "Out")).collect()}
    assert got == {i: "ab"[i % 2] for i in range(10, 40)}
    joined = e._plan(e.systems[0], e.world, None)
    assert "NestedLoop" not in plan_of(joined) and "p0.Has" not in joined.columns
    # a member's value moves only its own pair
    before = e.profile()["m"]["runs"]
    e.put(12, Size=99)
    e.settle()
    assert e.profile()["m"]["runs"] == before + 1


def test_tables_loaded_later_are_news(spark, table):
    @system("n", Query(Entity(), "Size"), outputs=["Sum"])
    def body(rows):
        yield Write("Sum", rows.select("_keys", F.col("`p0.entity`").alias("entity"), F.col("`p0.Size`").alias("value")))

    e = Engine(spark, PARTS, systems=[body])
    e.put(5000, Size=1)
    e.settle()
    e.load(from_table(table, "k", Name="name"))
    e.settle()
    e.load(from_table(table.where("k < 10"), "k", Size="size"))
    assert e.read(Query("Sum")).count() == 11 and e.profile()["n"]["runs"] == 11


def test_small_changes_are_layers(spark, table):
    @system("shout", Query(Entity(), "Name"), outputs=["Out"])
    def body(rows):
        yield Write("Out", rows.select("_keys", F.col("`p0.entity`").alias("entity"), F.upper("`p0.Name`").alias("value")))

    e = Engine(spark, PARTS, systems=[body])
    e.load(from_table(table, "k", Name="name", Size="size"))
    e.settle()
    e.update("Name", F.when(F.col("entity") < 5, F.lit("new")).otherwise(F.col("value")))
    e.settle()
    assert e.profile()["shout"]["runs"] == 2005
    layer = e.world.tables["Out"]
    assert layer.delta is not None and layer.delta.count() == 5 and layer.n == 2000
    e.remove("Name", [0, 1])
    e.despawn(spark.range(2, 4).selectExpr("id AS entity"))
    assert e.read(Query(Entity(), "Name")).count() == 1996 and e.world.tables["Name"].n == 1996
    e.update("Name", F.lit("x"))  # most of the table: written anew
    e.settle()
    assert e.world.tables["Name"].delta is None and {r.Out for r in e.read(Query("Out")).collect()} >= {"X"}


def test_revision_fields_and_untracked_components(spark):
    tree, mark = Component("Tree", "struct<revision:bigint,body:string>", revision="revision"), Component("Mark", untracked=True)

    @system("count", Query(Entity(), "Tree", where=With("Mark")), outputs=["Sum"])
    def body(rows):
        yield Write("Sum", rows.select("_keys", F.col("`p0.entity`").alias("entity"), F.length("`p0.Tree`.body").cast("long").alias("value")))

    e = Engine(spark, [*PARTS, tree, mark], systems=[body])
    e.put(1, Tree=(1, "abc"), Mark=True)
    assert [r.Sum for r in e.read(Query("Sum")).collect()] == [3]
    for tree_value, runs in [((1, "abc"), 1), ((2, "abcd"), 2)]:
        e.put(1, Tree=tree_value)
        e.settle()
        assert e.profile()["count"]["runs"] == runs
    e.put(1, Mark=True)
    e.settle()
    assert e.profile()["count"]["runs"] == 2


def test_outer_join_loses_its_partner(spark):
    @system("o", Query(Entity(), "Name", "Group"), Maybe(Query(Entity(), "Size", where=Eq("Group"))), outputs=["Sum"])
    def body(rows):
        yield Spawn(rows.select("_keys", F.coalesce("`p1.Size`", F.lit(999)).alias("Sum")), ("Sum",))

    e = Engine(spark, PARTS, systems=[body])
    e.put(1, Name="a", Group=1)
    e.put(10, Size=42, Group=1)
    assert [r.Sum for r in e.read(Query("Sum")).collect()] == [42]
    e.despawn([10])
    assert [r.Sum for r in e.read(Query("Sum")).collect()] == [999]


def test_always_run_once_a_generation(spark):
    ran = []

    @system("tick", Query(Entity(), "Name"), always=True)
    def body(rows):
        ran.append(rows.count())
        return ()

    e = Engine(spark, PARTS, systems=[body])
    e.put(1, Name="a")
    e.settle()
    e.put(2, Size=1)
    e.settle()
    assert ran == [1, 1]


def test_events_and_insert_on(spark):
    e = Engine(spark, PARTS)
    e.insert_on("settled", 50, Size=1)
    e.put(1, Name="a")
    e.settle()
    assert e.last_settled(Query("Size")).isEmpty()
    assert e.read(Query("Size")).count() == 1
    assert e.counters["settles"] == 2
    e.close()


def test_streams(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, f"v{i}"), (9, f"last{i}")], "k long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    e, seen = Engine(spark, PARTS), []
    stream = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for checkpoint in ("a", "b"):  # delivered twice: nothing changes
        ingest(e, stream, "k", f"{tmp_path}/{checkpoint}", after=seen.append, Name="v").awaitTermination()
    got = {r.entity: r.Name for r in e.read(Query(Entity(), "Name")).collect()}
    assert {k: v for k, v in got.items() if k < 9} == {0: "v0", 1: "v1", 2: "v2"} and got[9].startswith("last") and len(seen) == 6


def test_scalars(spark):
    rows = [("fn añb_1(x)", o) for o in range(-1, 14)]
    df = spark.createDataFrame(rows, "t string, o long").select(word_at(F.col("t"), F.col("o")).alias("w"))
    text = "fn añb_1(x)".encode()

    def brute(o):
        if not 0 <= o < len(text) or not (chr(text[o]).isascii() and (chr(text[o]).isalnum() or text[o] == 95)):
            return None
        ok = lambda b: b < 128 and (chr(b).isalnum() or b == 95)
        a = b = o
        while a and ok(text[a - 1]):
            a -= 1
        while b < len(text) and ok(text[b]):
            b += 1
        return text[a:b].decode()

    assert [r.w for r in df.collect()] == [brute(o) for _, o in rows]
    r = spark.createDataFrame([("ab\ncé",)], "t string").select(byte_length(F.col("t")).alias("n"), first_line(F.col("t")).alias("f")).first()
    assert (r.n, r.f) == (6, "ab")


def test_lcg_closed_form(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(1).getrandbits(64) - 2**63 for _ in range(5))]
    for steps in (1, 5, 120_000):
        got = spark.createDataFrame([(v,) for v in values], "v long").select(lcg(F.col("v"), steps).alias("x"))
        want = []
        for v in values:
            a, c = 1, 0
            for _ in range(steps):
                a, c = a * 6364136223846793005 % 2**64, (c * 6364136223846793005 + 1442695040888963407) % 2**64
            want.append((a * v + c) % 2**64)
        assert [int(r.x) for r in got.collect()] == want


def test_declarations_of_the_toy_language():
    text = "import std.io\nnamespace app.core {\nfn boot(x: T) -> U { return 1; }\ntype Size\nnamespace in { struct Box { w: Size } struct Bare }\n}\nfn main() { return \"}\"; }"
    got = [(kind, name, within) for kind, name, _, _, within in language.declarations(text)]
    assert got == [("import", "std.io", None), ("namespace", "app.core", None), ("function", "boot", "app.core"), ("type", "Size", "app.core"), ("namespace", "app.core.in", "app.core"), ("type", "Box", "app.core.in"), ("type", "Bare", "app.core.in"), ("function", "main", None)]
    spans = {name: text.encode()[a:b].decode() for _, name, a, b, _ in language.declarations(text)}
    assert spans["std.io"] == "import std.io" and spans["main"] == 'fn main() { return "}"; }'
    assert list(language.declarations("fn ( } } import")) == []


def test_language_serves_hover_and_replicas(spark):
    e = language.language(spark, language.replication())
    e.put(1, FilePath="a.toy", FileText="fn alpha() { return 1; }")
    with e.request(100, HoverRequest=True, FilePath="a.toy", Position=3) as r:
        assert "`alpha` is a function definition" in r.take("HoverInfo")
    assert e.read(Query(Entity(), "HoverCandidate")).isEmpty()
    kinds = lambda: sorted(r.shape for r in e.read(Query(Entity(), "Replica")).select("Replica.shape").collect())
    assert kinds() == ["ast_def", "source_file"]
    assert e.read(Query("Diagnostic")).isEmpty()  # nobody has asked for diagnostics
    e.put(1, FileText="fn alpha() { return 1; }\nfn two() { return 2; }")
    assert kinds() == ["ast_def", "ast_def", "source_file"]


def test_duplicates_are_of_the_earlier_definition(spark):
    """Whatever the entities that rules gave them: in the order of files, and of the text."""
    e = language.language(spark)
    names = [f"name{i}" for i in range(6)]
    e.put(2, FilePath="b.toy", FileText="\n".join(f"fn {n}() {{ return 2; }}" for n in names))
    e.put(1, FilePath="a.toy", FileText="\n".join(f"fn {n}() {{ return 0; }}\ntype {n}" for n in reversed(names)))
    e.put(DiagnosticsDemand=True)
    defs = {r.entity: (r.BelongsToFile, r.AstDef.start, r.AstDef.name) for r in e.read(Query(Entity(), "AstDef", "BelongsToFile")).collect()}
    first = {}
    for entity, (file, start, name) in sorted(defs.items(), key=lambda d: d[1][:2]):
        first.setdefault(name, entity)
    said = sorted(r.Diagnostic for r in e.read(Query("Diagnostic")).collect())
    assert said == sorted(f"duplicate definition `{n}`; previous function is entity {first[n]}" for n in names for _ in range(2))
