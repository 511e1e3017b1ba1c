"""A toy language served by rules: parsing, namespaces, imports, hover requests, diagnostics, replicas.

A file is parsed in one row-wise pass (a table function over Arrow batches);
everything else is joins between what parsing found.  Positions are in bytes.
Of definitions the earlier one is that of the lesser file, in one file that of the lesser position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine, Spawn, System, Write, system
from ..functions.scalar import word_at
from ..model import Component, Plugin, Shape
from ..plans.query import Entity, Eq, Maybe, Query, With
from ..sources.tables import from_table

QUERIES, ORACLES = {}, {}

TOKEN = re.compile(rb'\s+|"(?:[^"\\]|\\.)*"|->|[.(),:{};]|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|.', re.DOTALL)
WORDS = {b"import", b"fn", b"type", b"struct", b"return", b"namespace"}
DECLARED = "_keys array<long>, file long, kind string, name string, start long, end long, within string, nth int"

#: Bands of answers: the more specific to the position, the higher.
POSITION, QUALIFIED, NAME, RESOLVED, NONE = 30, 20, 10, 1, 0
WARNING, ERROR = 1, 2


def declarations(text: str) -> Iterator[tuple[str, str, int, int, str | None]]:
    """(kind, name, start, end, enclosing namespace) of each import, namespace, type, struct and function."""
    tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text.encode()) if not m[0].isspace()]
    at, spaces = 0, []  # spaces: (path, depth at which its braces close)
    depth = 0

    def name_like(i: int) -> bool:
        return i < len(tokens) and re.match(rb"[A-Za-z_]", tokens[i][0]) is not None and tokens[i][0] not in WORDS

    def path(i: int) -> tuple[str, int]:
        names = []
        while name_like(i):
            names.append(tokens[i][0].decode())
            if i + 1 < len(tokens) and tokens[i + 1][0] == b"." and name_like(i + 2):
                i += 2
            else:
                return ".".join(names), i + 1
        return ".".join(names), i

    def closing(i: int) -> int:
        """The token after the braces that open at or after i, or after i if none do."""
        level = 0
        while i < len(tokens):
            level += (tokens[i][0] == b"{") - (tokens[i][0] == b"}")
            i += 1
            if level == 0 and tokens[i - 1][0] == b"}":
                return i
        return i

    while at < len(tokens):
        word, start, _ = tokens[at]
        inside = spaces[-1][0] if spaces else None
        if word == b"import" and name_like(at + 1):
            name, at = path(at + 1)
            yield "import", name, start, tokens[at - 1][2], inside
        elif word == b"namespace" and name_like(at + 1):
            first = at + 1
            name, at = path(first)
            full = f"{inside}.{name}" if inside else name
            yield "namespace", full, tokens[first][1], tokens[at - 1][2], inside
            if at < len(tokens) and tokens[at][0] == b"{":
                depth += 1
                spaces.append((full, depth))
                at += 1
        elif word in (b"fn", b"struct") and name_like(at + 1):
            name = tokens[at + 1][0].decode()
            has_body = word == b"fn" or at + 2 < len(tokens) and tokens[at + 2][0] == b"{"
            after = closing(at + 2) if has_body else at + 2
            yield ("function" if word == b"fn" else "type"), name, start, tokens[after - 1][2], inside
            at = after
        elif word == b"type" and name_like(at + 1):
            yield "type", tokens[at + 1][0].decode(), start, tokens[at + 1][2], inside
            at += 2
        else:
            if word == b"}" and spaces and spaces[-1][1] == depth:
                spaces.pop()
                depth -= 1
            at += 1


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, e, *d, n) for k, e, t in zip(b["_keys"], b["entity"], b["text"]) for n, d in enumerate(declarations(t))]
        yield pd.DataFrame(rows, columns=["_keys", "file", "kind", "name", "start", "end", "within", "nth"])


def col(name: str):
    return F.col(f"`{name}`")


SPAN = "kind string, name string, start long, end long"
COMPONENTS = [
    Component("FilePath", "string", hash=True),
    Component("FileText", "string", hash=True),
    Component("HoverRequest"),
    Component("Position", "long", hash=True),
    Component("DiagnosticsDemand", singleton=True),
    Component("ImportDb", "array<string>", hash=True, singleton=True),
    Component("AstDef", f"struct<{SPAN.replace(' ', ':').replace(',:', ',')}>", hash=True),
    Component("ImportDecl", f"struct<{SPAN.replace(' ', ':').replace(',:', ',')}>", hash=True),
    Component("NamespaceDecl", f"struct<{SPAN.replace(' ', ':').replace(',:', ',')}>", hash=True),
    Component("BelongsToFile", "long", hash=True),
    Component("NamespacePath", "string", hash=True),
    Component("QualifiedName", "struct<definition:bigint,name:string>", hash=True),
    Component("Diagnostic", "string", hash=True),
    Component("Severity", "int", hash=True),
    # how many definitions there are and a digest of all: it moves when any of them does, and is no list of them
    Component("DefIndex", "struct<n:bigint,digest:bigint>", hash=True, singleton=True),
    Component("RequestKey", "long", hash=True),
    Component("HoverCandidate", "struct<priority:int,text:string>", hash=True),
    Component("HoverFile", "long", hash=True),
    Component("HoverWord", "string", hash=True),
    Component("HoverRank", "int", hash=True),
    Component("HoverInfo", "string", hash=True),
    Component("DerivedFrom", provenance=True),
]
SHAPES = [
    Shape("source_file", ("FilePath", "FileText")),
    Shape("hover_request", ("HoverRequest", "FilePath", "Position"), ("RequestKey", "HoverFile", "HoverWord", "HoverRank", "HoverInfo")),
    Shape("ast_def", ("AstDef", "BelongsToFile", "DerivedFrom"), ("NamespacePath",)),
    Shape("import", ("ImportDecl", "BelongsToFile", "DerivedFrom")),
    Shape("namespace", ("NamespaceDecl", "NamespacePath", "BelongsToFile", "DerivedFrom")),
    Shape("qualified_name", ("QualifiedName", "DerivedFrom")),
    Shape("diagnostic", ("Diagnostic", "Severity", "DerivedFrom")),
    Shape("def_index", ("DefIndex",)),
    # candidates go with their request; they don't note its revision, which their own answer moves
    Shape("hover_candidate", ("HoverCandidate", "RequestKey")),
]


# The messages that the language gives.
UNKNOWN_IMPORT = "unknown import `%s`"
DUPLICATE = "duplicate definition `%s`; previous %s is entity %d"
UNKNOWN_FILE, NO_SYMBOL, UNRESOLVED = "unknown file", "no symbol at position", "unresolved symbol `%s`"
DEFINED, KNOWN_AS, IMPORTED = "`%s` is a %s definition on entity %d", "`%s` is a %s definition on entity %d, known as `%s`", "`%s` is %s import"


def _first(view: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the least by ``order``."""
    rest = [c for c in view.columns if c not in on]
    return view.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*on, *[F.col(f"_f.{c}").alias(c) for c in rest])


def rules() -> list[System]:
    anchors = "DerivedFrom"

    @system("parse_file", Query(Entity(), "FileText"), keeps=True)
    def parse_file(rows, keep):
        texts = rows.select("_keys", col("p0.entity").alias("entity"), col("p0.FileText").alias("text"))
        found = keep(texts.repartition("entity").mapInPandas(_parse, DECLARED))  # a small file is one partition, however many texts its rows make
        span = F.struct("kind", "name", "start", "end")
        some = lambda kinds: found.where(F.col("kind").isin(kinds)).withColumn("BelongsToFile", F.col("file"))
        yield Spawn(some(["import"]).withColumn("ImportDecl", span), ("ImportDecl", "BelongsToFile"), "nth", anchors)
        yield Spawn(some(["namespace"]).withColumn("NamespaceDecl", span).withColumn("NamespacePath", F.col("name")), ("NamespaceDecl", "NamespacePath", "BelongsToFile"), "nth", anchors)
        yield Spawn(some(["function", "type"]).withColumn("AstDef", span).withColumn("NamespacePath", F.col("within")), ("AstDef", "BelongsToFile", "NamespacePath"), "nth", anchors)

    @system("qualify_members", Query(Entity(), "NamespaceDecl", "NamespacePath"), Query(Entity(), "AstDef", where=Eq("NamespacePath")))
    def qualify_members(rows):
        name = F.concat_ws(".", "`p0.NamespaceDecl`.name", "`p1.AstDef`.name")
        yield Spawn(rows.select("_keys", F.struct(col("p1.entity").alias("definition"), name.alias("name")).alias("QualifiedName")), ("QualifiedName",), anchors=anchors)

    @system("check_imports", Query(Entity(), where=With("DiagnosticsDemand")), Query(Entity(), "ImportDecl"), views={"db": Query(Entity(), "ImportDb")})
    def check_imports(rows, db):
        known = db.select(F.explode("ImportDb").alias("known"))
        missing = rows.join(known, F.col("`p1.ImportDecl`.name") == F.col("known"), "left_anti")
        yield Spawn(missing.select("_keys", F.format_string(UNKNOWN_IMPORT, F.col("`p1.ImportDecl`.name")).alias("Diagnostic"), F.lit(WARNING).alias("Severity")), ("Diagnostic", "Severity"), anchors=anchors)

    @system("index_defs", Query(Entity(), where=With("DiagnosticsDemand")), Query(Entity(), "FileText"), views={"defs": Query(Entity(), "AstDef"), "paths": Query(Entity(), "NamespacePath")}, phase="complete")
    def index_defs(rows, defs, paths):
        each = F.xxhash64("AstDef.name", "NamespacePath", "entity")
        held = defs.join(paths, "entity", "left").select(each.alias("h")).agg(F.struct(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(h)"), F.lit(0).cast("long")).alias("digest")).alias("value"))
        yield Write("DefIndex", rows.select("_keys", col("p1.entity").alias("entity")).crossJoin(held))

    @system("check_duplicate_defs", Query(Entity(), where=With("DiagnosticsDemand")), Query(Entity(), "AstDef"), Query(Entity(), "DefIndex"), views={"defs": Query(Entity(), "AstDef", "BelongsToFile"), "paths": Query(Entity(), "NamespacePath")}, phase="complete")
    def check_duplicate_defs(rows, defs, paths):
        scoped = defs.join(paths, "entity", "left").select("entity", F.col("AstDef.name").alias("name"), F.col("AstDef.kind").alias("kind"), F.coalesce("NamespacePath", F.lit("")).alias("scope"), F.col("BelongsToFile").alias("file"), F.col("AstDef.start").alias("start"))
        first = _first(scoped, ["name", "scope"], ["file", "start"]).select(F.col("name").alias("_n"), F.col("scope").alias("_s"), F.col("entity").alias("_e"), F.col("kind").alias("_k"), F.struct("file", "start").alias("_at"))
        own = rows.select("_keys", col("p1.entity").alias("entity")).join(scoped.select("entity", "name", "scope", F.struct("file", "start").alias("at")), "entity")
        met = own.join(first, (F.col("name") == F.col("_n")) & (F.col("scope") == F.col("_s")) & (F.col("_at") < F.col("at")))
        text = F.format_string(DUPLICATE, F.col("_n"), F.col("_k"), F.col("_e"))
        yield Spawn(met.select("_keys", text.alias("Diagnostic"), F.lit(ERROR).alias("Severity")), ("Diagnostic", "Severity"), anchors=anchors)

    @system("resolve_hover", Query(Entity(), "FilePath", "Position", where=With("HoverRequest")), Maybe(Query(Entity(), "FileText", where=Eq("FilePath"))))
    def resolve_hover(rows):
        at = rows.select("_keys", col("p0.entity").alias("entity"), col("p1.entity").alias("file"), word_at(col("p1.FileText"), col("p0.Position")).alias("word"))
        info = F.when(F.col("file").isNull(), UNKNOWN_FILE).when(F.col("word").isNull(), NO_SYMBOL).otherwise(F.format_string(UNRESOLVED, F.col("word")))
        rank = F.when(F.col("file").isNull(), NONE).otherwise(RESOLVED)
        for component, value in [("RequestKey", F.col("entity")), ("HoverFile", F.col("file")), ("HoverWord", F.col("word"))]:
            yield Write(component, at.select("_keys", "entity", value.alias("value")))
        yield Spawn(at.select("_keys", F.struct(rank.alias("priority"), info.alias("text")).alias("HoverCandidate"), F.col("entity").alias("RequestKey")), ("HoverCandidate", "RequestKey"))

    def candidate(rows, priority, text):
        return Spawn(rows.select("_keys", F.struct(F.lit(priority).alias("priority"), text.alias("text")).alias("HoverCandidate"), col("p0.entity").alias("RequestKey")), ("HoverCandidate", "RequestKey"))

    asked = Query(Entity(), "HoverWord", where=With("HoverRequest"))

    def first_named(defs):
        at = defs.select(F.col("AstDef.name").alias("name"), "entity", F.col("AstDef.kind").alias("kind"), F.col("BelongsToFile").alias("file"), F.col("AstDef.start").alias("start"))
        return _first(at, ["name"], ["file", "start"]).drop("file", "start")

    @system("hover_definitions", asked, views={"defs": Query(Entity(), "AstDef", "BelongsToFile")}, phase="complete")
    def hover_definitions(rows, defs):
        met = rows.join(first_named(defs), col("p0.HoverWord") == F.col("name"))
        yield candidate(met, NAME, F.format_string(DEFINED, "name", "kind", "entity"))

    @system("hover_qualified", asked, views={"defs": Query(Entity(), "AstDef", "BelongsToFile"), "qualified": Query(Entity(), "QualifiedName")}, phase="complete")
    def hover_qualified(rows, defs, qualified):
        full = _first(qualified.select(F.col("QualifiedName.definition").alias("definition"), F.col("QualifiedName.name").alias("full")), ["definition"], ["full"])
        met = rows.join(first_named(defs), col("p0.HoverWord") == F.col("name")).join(full, F.col("entity") == F.col("definition"))
        yield candidate(met, QUALIFIED, F.format_string(KNOWN_AS, "name", "kind", "entity", "full"))

    @system("hover_imports", Query(Entity(), "HoverFile", "Position", where=With("HoverRequest")), views={"imports": Query(Entity(), "BelongsToFile", "ImportDecl"), "db": Query(Entity(), "ImportDb")}, phase="complete")
    def hover_imports(rows, imports, db):
        inside = (F.col("BelongsToFile") == col("p0.HoverFile")) & (F.col("ImportDecl.start") <= col("p0.Position")) & (col("p0.Position") < F.col("ImportDecl.end"))
        known = db.select(F.explode("ImportDb").alias("known"))
        met = rows.join(imports, inside).join(known, F.col("ImportDecl.name") == F.col("known"), "left")
        yield candidate(met, POSITION, F.format_string(IMPORTED, F.col("ImportDecl.name"), F.when(F.col("known").isNull(), "an unknown").otherwise("a known")))

    @system("finalize_hover", Query(Entity(), "RequestKey", where=With("HoverRequest")), views={"candidates": Query(Entity(), "RequestKey", "HoverCandidate")}, phase="complete")
    def finalize_hover(rows, candidates):
        best = candidates.groupBy(F.col("RequestKey").alias("_r")).agg(F.max("HoverCandidate").alias("best"))
        met = rows.join(best, col("p0.RequestKey") == F.col("_r"))
        for component, part in [("HoverRank", "priority"), ("HoverInfo", "text")]:
            yield Write(component, met.select("_keys", col("p0.entity").alias("entity"), F.col(f"best.{part}").alias("value")))

    return [parse_file, qualify_members, check_imports, index_defs, check_duplicate_defs, resolve_hover, hover_definitions, hover_qualified, hover_imports, finalize_hover]


def replication() -> Plugin:
    """Keeps one replica record for each source file and definition."""

    def keep(shape: str, part: str) -> System:
        @system(f"replicate_{shape}", Query(Entity(), part))
        def body(rows):
            yield Spawn(rows.select("_keys", F.struct(col("p0.entity").alias("source"), F.lit(shape).alias("shape")).alias("Replica")), ("Replica",), anchors="DerivedFrom")

        return body

    replica = Component("Replica", "struct<source:bigint,shape:string>", hash=True)
    return Plugin([replica], [Shape("replica", ("Replica", "DerivedFrom"))], [keep("source_file", "FileText"), keep("ast_def", "AstDef")])


def language(spark: SparkSession, *plugins: Plugin) -> Engine:
    # an anchor is written after the wave's own commit, so shapes that need one are checked without it
    shapes = [Shape(s.name, tuple(p for p in s.required if p != "DerivedFrom"), (*s.optional, *(p for p in s.required if p == "DerivedFrom"))) for s in SHAPES]
    plugins = [Plugin(p.components, [Shape(s.name, tuple(x for x in s.required if x != "DerivedFrom"), ("DerivedFrom",)) for s in p.shapes], p.systems) for p in plugins]
    e = Engine(spark, COMPONENTS, shapes, rules(), plugins, commit_limit=None)
    e.put(ImportDb=["std.io"])
    return e


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# One file a part: two imports, a namespace that four files share, two functions and a type in it.
HEAD = ["import std.io\nimport lib", "k % 3", ".core\nnamespace app", "k DIV 4", " {\n"]
FIRST, SECOND, LAST = ["fn f", "k % 7", "() { return 1; }"], ["fn f", "k % 3", "() { return 2; }"], ["type T", "k", "\n}\n"]


def _text(parts: list[str]) -> str:
    """Spark SQL of a text: every other part is an expression."""
    return "concat(" + ", ".join(p if i % 2 else repr(p) for i, p in enumerate(parts)) + ")"


def _sql(parts: list[str]) -> str:
    """The same for DuckDB."""
    quote = lambda p: " || chr(10) || ".join(f"'{x}'" for x in p.split("\n"))
    return " || ".join(f"({p.replace('DIV', '//')})" if i % 2 else quote(p) for i, p in enumerate(parts))


def served(spark: SparkSession, sf_dir: str) -> Engine:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CAST(p_partkey AS BIGINT) AS k")
    whole = f"concat({_text(HEAD)}, {_text(FIRST)}, '\\n', {_text(SECOND)}, '\\n', {_text(LAST)})"
    e = language(spark)
    e.load(from_table(parts, "k", FilePath=F.expr("concat('p', k, '.toy')"), FileText=F.expr(whole)))
    e.put(ImportDb=["std.io", "lib1.core"])
    return e


DEFINITIONS = f"""WITH p AS (SELECT p_partkey::BIGINT AS k, {_sql(HEAD)} AS head, {_sql(FIRST)} AS one FROM (SELECT p_partkey, p_partkey AS k FROM part)),
d AS (SELECT k, 'app' || (k // 4) AS scope, 'f' || (k % 7) AS name, strlen(head)::BIGINT AS start, 'function' AS kind FROM p
    UNION ALL SELECT k, 'app' || (k // 4), 'f' || (k % 3), strlen(head) + strlen(one) + 1, 'function' FROM p
    UNION ALL SELECT k, 'app' || (k // 4), 'T' || k, NULL, 'type' FROM p)
"""


@_query(DEFINITIONS + "SELECT d.scope || '.' || d.name AS name, d.k AS file, count(*) AS known FROM d JOIN p ON d.scope = 'app' || (p.k // 4) GROUP BY ALL")
def qualified_names(spark, sf_dir):
    """Each definition under each namespace declaration of its path, in whatever file."""
    e = served(spark, sf_dir)
    e.settle()
    names, files = e.read(Query(Entity(), "QualifiedName"), Query(Entity(), "AstDef", "BelongsToFile"))
    at = files.select(F.col("entity").alias("definition"), F.col("BelongsToFile").alias("file"))
    return names.select("QualifiedName.name", "QualifiedName.definition").join(at, "definition").groupBy("name", "file").agg(F.count("*").alias("known"))


@_query(DEFINITIONS + """SELECT 'unknown import `lib' || (k % 3) || '.core`' AS message, 1 AS severity, k AS file, 14::BIGINT AS start, NULL::BIGINT AS previous_file, NULL::BIGINT AS previous_start FROM p WHERE k % 3 <> 1
UNION ALL SELECT 'duplicate definition `' || name || '`; previous ' || kind || ' is entity', 2, k, start, first_value(k) OVER w, first_value(start) OVER w
    FROM d WHERE kind = 'function' WINDOW w AS (PARTITION BY scope, name ORDER BY k, start) QUALIFY row_number() OVER w > 1""")
def diagnostics(spark, sf_dir):
    """The whole messages; the entity that one names, and the ones it is derived from, by the places they stand for."""
    e = served(spark, sf_dir)
    e.put(DiagnosticsDemand=True)
    e.settle()
    found, defs, imports = e.read(Query(Entity(), "Diagnostic", "Severity", "DerivedFrom"), Query(Entity(), "AstDef", "BelongsToFile"), Query(Entity(), "ImportDecl", "BelongsToFile"))
    place = lambda df, c: df.select(F.col("entity").alias("_p"), F.col("BelongsToFile").alias("file"), F.col(f"{c}.start").alias("start"))
    places = place(defs, "AstDef").unionByName(place(imports, "ImportDecl"))
    each = found.select(F.regexp_replace("Diagnostic", " -?[0-9]+$", "").alias("message"), F.col("Severity").alias("severity"), F.explode("DerivedFrom.entity").alias("_from"), F.regexp_extract("Diagnostic", "(-?[0-9]+)$", 1).try_cast("long").alias("_named"))
    met = each.join(places.withColumnRenamed("_p", "_from"), "_from")
    named = places.select(F.col("_p").alias("_named"), F.col("file").alias("previous_file"), F.col("start").alias("previous_start"))
    return met.join(named, "_named", "left").select("message", "severity", "file", "start", "previous_file", "previous_start")


@_query(DEFINITIONS + """, f AS (SELECT name, arg_min(scope, (k, start)) AS scope FROM d GROUP BY name)
SELECT k AS request, CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 1 ELSE 0 END AS rank,
    CASE k % 4 WHEN 0 THEN '`lib' || (k % 3) || '.core` is ' || CASE WHEN k % 3 = 1 THEN 'a known' ELSE 'an unknown' END || ' import'
    WHEN 1 THEN '`f' || (k % 7) || '` is a function definition on entity, known as `' || (SELECT scope FROM f WHERE name = 'f' || (k % 7)) || '.f' || (k % 7) || '`'
    WHEN 2 THEN 'no symbol at position' ELSE 'unknown file' END AS info FROM p""")
def hover_resolution(spark, sf_dir):
    """A request in each file: on its second import, on the name of a function, on a line's end, and in a file that isn't there."""
    e = served(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CAST(p_partkey AS BIGINT) AS k").selectExpr(
        "k + (1L << 50) AS request", "true AS demand", "IF(k % 4 = 3, 'nowhere.toy', concat('p', k, '.toy')) AS path", f"CAST(CASE k % 4 WHEN 0 THEN 21 WHEN 1 THEN octet_length({_text(HEAD)}) + 3 ELSE 13 END AS BIGINT) AS position"
    )
    e.insert_rows(asked, "request", HoverRequest="demand", FilePath="path", Position="position")
    shown = F.regexp_replace("HoverInfo", " entity -?[0-9]+", " entity")
    return e.read(Query(Entity(), "HoverRank", "HoverInfo")).select((F.col("entity") - F.lit(1 << 50)).alias("request"), F.col("HoverRank").alias("rank"), shown.alias("info"))
