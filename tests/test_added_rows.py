"""Rows of entities that are new to a table are put beside the others, as they were saved."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import Component, Engine, Entity, Query, Spawn, Write, from_table, system

COMPONENTS = [Component("Key", "long", hash=True), Component("Size", "long", hash=True), Component("Left", "long", hash=True), Component("Right", "long", hash=True)]


def files(e, name):
    return set(e.settled.table(name).inputFiles())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@system("copy", Query(Entity(), "Key"), outputs=["Left", "Right"])
def copy(rows):
    yield Spawn(rows.selectExpr("_keys", "`p0.Key` AS Left", "IF(`p0.Key` % 2 = 0, `p0.Key` * 2, NULL) AS Right"), ("Left", "Right"))


def test_one_write_for_all_columns_of_a_bundle_or_a_spawn(spark):
    e = Engine(spark, COMPONENTS, systems=[copy], commit_limit=None)
    e.load(from_table(spark.range(5).withColumn("k", F.col("id") + 100), "id", Key="k"))
    e.insert_rows(spark.createDataFrame([(10, 1, 7), (11, 2, None), (None, 3, 9)], "entity long, k long, size long"), "entity", Key="k", Size="size")
    assert rows(e.read(Query("Left")).select("Left")) == [(1,), (2,), (100,), (101,), (102,), (103,), (104,)]
    assert rows(e.read(Query("Right")).select("Right")) == [(4,), (200,), (204,), (208,)]
    assert rows(e.read(Query(Entity(), "Size"))) == [(10, 7)]
    assert e.settled.tables["Key"].n == 7 and e.settled.tables["Right"].n == 4
    assert files(e, "Left") == files(e, "Right") and files(e, "Key") == files(e, "Size")
    e.put(11, Key=12)  # and what is derived from it follows
    assert rows(e.read(Query("Left")).select("Left")) == [(1,), (12,), (100,), (101,), (102,), (103,), (104,)]
    assert rows(e.read(Query("Right")).select("Right")) == [(24,), (200,), (204,), (208,)]


def test_an_entity_that_is_there_twice_is_still_one_row(spark):
    @system("low", Query(Entity(), "Key"), outputs=["Left"])
    def low(rows):
        yield Write("Left", rows.selectExpr("_keys", "`p0.Key` AS entity", "`p0.entity` AS value"))

    e = Engine(spark, COMPONENTS, systems=[low], commit_limit=None)
    e.insert_rows(spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "entity long, k long"), "entity", Key="k")
    assert rows(e.read(Query(Entity(), "Left"))) == [(5, 2), (6, 3)]  # the writer of the greatest keys
    e.insert_rows(spark.createDataFrame([(3, 8), (4, 7), (4, 7)], "entity long, k long"), "entity", Key="k")
    assert rows(e.read(Query(Entity(), "Key"))) == [(1, 5), (2, 5), (3, 8), (4, 7)]
    assert rows(e.read(Query(Entity(), "Left"))) == [(5, 2), (7, 4), (8, 3)]


def test_anchors_of_whole_tables_are_not_looked_up(spark):
    from tidemark.workloads.language import language

    e = language(spark)
    texts = spark.range(3).selectExpr("id", "concat('p', id, '.toy') AS path", "concat('import lib', id, '\nnamespace app { fn f', id, '() { } type T }') AS text").coalesce(1)
    e.load(from_table(texts, "id", FilePath="path", FileText="text"))
    names = Query(Entity(), "QualifiedName", "DerivedFrom")
    defs, found = e.read(Query(Entity(), "AstDef", "BelongsToFile", "DerivedFrom"), names)
    rev = e.settled.watermark["FileText"]
    assert rows(defs.selectExpr("BelongsToFile", "DerivedFrom.entity", "DerivedFrom.rev")) == sorted([(i, [i], [rev]) for i in range(3)] * 2)
    assert found.count() == 18  # three declarations of app, six definitions in it
    born = e.settled.watermark["AstDef"]
    assert {tuple(r.DerivedFrom) for r in found.selectExpr("DerivedFrom.rev AS DerivedFrom").collect()} == {(born, born)}
    made = [files(e, n) for n in ("AstDef", "ImportDecl", "NamespaceDecl", "QualifiedName")]
    assert files(e, "DerivedFrom") == set().union(*made)  # none of its own: nothing was grouped or joined for them
    e.put(1, FileText="namespace app { fn g() { } }")  # what came from the old text goes, the rest stays
    assert rows(e.read(names).select("QualifiedName.name")) == sorted([("app.f0",), ("app.T",), ("app.f2",), ("app.T",), ("app.g",)] * 3)
    assert rows(e.read(Query("ImportDecl")).selectExpr("ImportDecl.name")) == [("lib0",), ("lib2",)]
    e.despawn([2])
    assert rows(e.read(names).select("QualifiedName.name")) == sorted([("app.f0",), ("app.T",), ("app.g",)] * 2)


def test_texts_of_one_small_file_are_parsed_by_several_tasks(spark):
    from tidemark.workloads.language import language

    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        e = language(spark)
        e.load(from_table(spark.range(200).selectExpr("id", "concat('p', id, '.toy') AS path", "concat('fn f', id, '() { }') AS text").coalesce(1), "id", FilePath="path", FileText="text"))
        e.settle()
        assert len(files(e, "AstDef")) == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
