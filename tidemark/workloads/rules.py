"""Queries over what rules derive: joins, folds, pipelines, fixed points, incremental settles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine, Remove, Spawn, System, Write, system
from ..functions.scalar import byte_length, first_line, word_at
from ..plans.query import And, Entity, Eq, Gte, In, Maybe, Optional, Query, Read, With
from . import schema

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def store(spark: SparkSession, systems: list[System], *sources) -> Engine:
    e = Engine(spark, schema.COMPONENTS, systems=systems, commit_limit=None)  # rules over whole tables
    for s in sources:
        e.load(s)
    return e


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def digest(text: Column) -> Column:
    """A text by its MD5 and length, for what compares whole texts."""
    return F.concat_ws(":", F.md5(text.cast("binary")), F.octet_length(text))


def write(rows: DataFrame, component: str, value: Column, entity: str = "p0.entity") -> Write:
    return Write(component, rows.select("_keys", col(entity).alias("entity"), value.alias("value")))


def spawn(rows: DataFrame, **values: Column) -> Spawn:
    return Spawn(rows.select("_keys", *[v.alias(n) for n, v in values.items()]), tuple(values))


def spawned(e: Engine, **names: str) -> DataFrame:
    """Spawned rows, their components renamed."""
    return e.read(Query(Entity(), *names.values())).select([F.col(c).alias(n) for n, c in names.items()])


# -- joins ---------------------------------------------------------------


@query("SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
def cross_product(spark, sf_dir):
    @system("pairs", Query(Entity(), "RegionName"), Query(Entity(), "NationName"), outputs=["OutText", "Label"])
    def body(rows):
        yield spawn(rows, OutText=col("p0.RegionName"), Label=col("p1.NationName"))

    e = store(spark, [body], schema.regions(spark, sf_dir), schema.nations(spark, sf_dir))
    return spawned(e, region="OutText", nation="Label")


@query("SELECT o_orderkey AS order_key FROM orders WHERE o_totalprice >= 400000")
def demand_gate(spark, sf_dir):
    """Nothing runs until the one-row gate is there."""

    @system("gated", Query(Entity(), where=With("Demand")), Query(Entity(), "OrderKey", where=Gte("OrderTotal", 400000.0)), outputs=["OutLong"])
    def body(rows):
        yield write(rows, "OutLong", col("p1.OrderKey"), "p1.entity")

    e = store(spark, [body], schema.orders(spark, sf_dir))
    before = e.read(Query("OutLong")).count()
    e.put(Demand=True)
    after = e.read(Query(Entity(), "OutLong"))
    return after.where(F.lit(before) == 0).select(F.col("OutLong").alias("order_key"))


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def eq_join(spark, sf_dir):
    @system("named", Query(Entity(), "NationName", "NationKey"), Query(Entity(), "CustomerName", where=Eq("NationKey")), outputs=["OutText"])
    def body(rows):
        yield write(rows, "OutText", col("p0.NationName"), "p1.entity")

    e = store(spark, [body], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    key = schema.read(spark, sf_dir, "customer").select(schema.kind_entity(schema.CUSTOMER, F.col("c_custkey")).alias("entity"), F.col("c_nationkey").alias("value"))
    e.insert(NationKey=key)
    return e.read(Query(Entity(), "CustomerName", "OutText")).select(F.col("CustomerName").alias("customer"), F.col("OutText").alias("nation"))


@query("SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM documents a JOIN documents b ON a.text = b.text WHERE a.lang = 'fr'")
def self_join(spark, sf_dir):
    """Self pairs are kept."""

    @system("same", Query(Entity(), "DocText", where=Eq("DocLang", "fr")), Query(Entity(), where=Eq("DocText")), outputs=["OutLeft", "OutRight"])
    def body(rows):
        yield spawn(rows, OutLeft=col("p0.entity"), OutRight=col("p1.entity"))

    return spawned(store(spark, [body], schema.documents(spark, sf_dir)), left_id="OutLeft", right_id="OutRight")


@query("SELECT a.event_id AS high, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.value >= 200")
def compound_join(spark, sf_dir):
    @system("both", Query(Entity(), "EventUser", "EventType", where=Gte("EventValue", 200.0)), Query(Entity(), where=And(Eq("EventUser"), Eq("EventType"))), outputs=["OutLeft", "OutRight"])
    def body(rows):
        yield spawn(rows, OutLeft=col("p0.entity"), OutRight=col("p1.entity"))

    return spawned(store(spark, [body], schema.events(spark, sf_dir)), high="OutLeft", other="OutRight")


@query("SELECT c_name AS customer, r_name AS region FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey")
def chain_join(spark, sf_dir):
    @system("chain", Query(Entity(), "RegionName", "RegionKey"), Query(Entity(), "NationKey", where=Eq("RegionKey")), Query(Entity(), "CustomerName", where=Eq("NationKey")), outputs=["OutText"])
    def body(rows):
        yield write(rows, "OutText", col("p0.RegionName"), "p2.entity")

    e = store(spark, [body], schema.regions(spark, sf_dir), schema.customers(spark, sf_dir))
    nation = schema.read(spark, sf_dir, "nation").select(schema.kind_entity(schema.NATION, F.col("n_nationkey")).alias("entity"), "n_nationkey", "n_regionkey")
    customer = schema.read(spark, sf_dir, "customer").select(schema.kind_entity(schema.CUSTOMER, F.col("c_custkey")).alias("entity"), F.col("c_nationkey").alias("value"))
    e.insert(NationKey=nation.select("entity", F.col("n_nationkey").alias("value")).union(customer), RegionKey=nation.select("entity", F.col("n_regionkey").alias("value")))
    # customers and nations both have a NationKey; only nations have a RegionKey, so each chain is region, nation, customer
    return e.read(Query(Entity(), "CustomerName", "OutText")).select(F.col("CustomerName").alias("customer"), F.col("OutText").alias("region"))


@query("SELECT o_orderkey AS order_key, l_quantity AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def outer_join(spark, sf_dir):
    @system("lines", Query(Entity(), "OrderKey", "OrderStatus"), Maybe(Query(Entity(), "Quantity", where=Eq("OrderKey"))), outputs=["OutLong", "OutDouble"])
    def body(rows):
        yield spawn(rows, OutLong=col("p0.OrderKey"), OutDouble=col("p1.Quantity"))

    e = store(spark, [body], schema.orders(spark, sf_dir))
    e.insert_rows(schema.lines(spark, sf_dir), "entity", OrderKey="l_orderkey", Quantity="l_quantity")
    found = e.read(Query(Entity(), "OutLong", Optional("OutDouble")))
    return found.select(F.col("OutLong").alias("order_key"), F.col("OutDouble").alias("quantity"))


@query("SELECT c_name AS customer, n_name AS nation FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal >= 5000")
def in_join(spark, sf_dir):
    @system("members", Query(Entity(), "NationName", "NationCustomers"), Query(Entity(), "CustomerName", where=And(In("NationCustomers"), Gte("Balance", 5000.0))), outputs=["OutText"])
    def body(rows):
        yield write(rows, "OutText", col("p0.NationName"), "p1.entity")

    e = store(spark, [body], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    return e.read(Query(Entity(), "CustomerName", "OutText")).select(F.col("CustomerName").alias("customer"), F.col("OutText").alias("nation"))


# -- folds ---------------------------------------------------------------


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents QUALIFY doc_id > first_id")
def earlier_duplicate(spark, sf_dir):
    """A rule over a view of all: the first earlier document of the same text; what is shuffled is 128 bits of each text and its length."""

    @system("first", Query(Entity(), "DocText"), views={"all": Query(Entity(), "DocText")}, outputs=["OutLong"])
    def body(rows, all):
        first = all.groupBy(digest(F.col("DocText")).alias("d")).agg(F.min("entity").alias("first"))
        own = rows.select("_keys", col("p0.entity"), digest(col("p0.DocText")).alias("d"))
        yield write(own.join(first, "d").where(F.col("first") < col("p0.entity")), "OutLong", F.col("first"))

    return store(spark, [body], schema.documents(spark, sf_dir)).read(Query(Entity(), "OutLong")).select(F.col("entity").alias("doc_id"), F.col("OutLong").alias("first_id"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text, source) AS first_id FROM documents QUALIFY doc_id > first_id")
def scoped_duplicate(spark, sf_dir):
    @system("first", Query(Entity(), "DocText", "DocSource"), views={"all": Query(Entity(), "DocText", "DocSource")}, outputs=["OutLong"])
    def body(rows, all):
        first = all.groupBy(digest(F.col("DocText")).alias("d"), F.col("DocSource").alias("s")).agg(F.min("entity").alias("first"))
        own = rows.select("_keys", col("p0.entity"), digest(col("p0.DocText")).alias("d"), col("p0.DocSource").alias("s"))
        yield write(own.join(first, ["d", "s"]).where(F.col("first") < col("p0.entity")), "OutLong", F.col("first"))

    return store(spark, [body], schema.documents(spark, sf_dir)).read(Query(Entity(), "OutLong")).select(F.col("entity").alias("doc_id"), F.col("OutLong").alias("first_id"))


@query("SELECT n_name AS nation, (SELECT count(*) FROM customer) AS customers FROM nation")
def view_count(spark, sf_dir):
    @system("count", Query(Entity(), "NationName"), views={"all": Query(Entity(), "CustomerName")}, outputs=["OutLong"])
    def body(rows, all):
        yield write(rows.crossJoin(all.agg(F.count("*").alias("n"))), "OutLong", F.col("n"))

    e = store(spark, [body], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    return e.read(Query(Entity(), "NationName", "OutLong")).select(F.col("NationName").alias("nation"), F.col("OutLong").alias("customers"))


@query("SELECT n_name AS nation FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 9900)")
def view_exists(spark, sf_dir):
    @system("any", Query(Entity(), "NationName"), views={"rich": Query(Entity(), "InNation", where=Gte("Balance", 9900.0))}, outputs=["OutText"])
    def body(rows, rich):
        met = rows.join(rich.select(F.col("InNation").alias("at")).distinct(), col("p0.entity") == F.col("at"), "left_semi")
        yield write(met, "OutText", col("p0.NationName"))

    e = store(spark, [body], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    return e.read(Query(Entity(), "OutText")).select(F.col("OutText").alias("nation"))


@query("SELECT string_agg(n_name || ':' || n_regionkey, ',' ORDER BY n_name) AS entries FROM nation")
def def_index(spark, sf_dir):
    """A sorted list of all names in one singleton."""
    from ..model import Component

    @system("index", Query(Entity(), where=With("Demand")), views={"all": Query(Entity(), "NationName", "InRegion")}, outputs=["Index"])
    def body(rows, all):
        entry = F.concat_ws(":", "NationName", (F.col("InRegion") - F.lit(schema.REGION * 2**48)).cast("string"))
        held = all.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("NationName", entry.alias("e")))), lambda s: s["e"]), ",").alias("held"))
        yield write(rows.crossJoin(held), "Index", F.col("held"))

    e = Engine(spark, [*schema.COMPONENTS, Component("Index", "string", hash=True, singleton=True)], systems=[body], commit_limit=None)
    e.load(schema.nations(spark, sf_dir))
    e.put(Demand=True)
    return e.read(Query("Index")).select(F.col("Index").alias("entries"))


@query("SELECT user_id, max_by(event_id, (value, -event_id)) AS event_id FROM (SELECT user_id, event_id, value FROM events) GROUP BY user_id")
def max_fold(spark, sf_dir):
    """Arbitration: the highest value of each user wins, the earliest event of equal ones; folds commute, so order is of no matter."""

    @system("best", Query(Entity(), where=With("Demand")), views={"all": Query(Entity(), "EventUser", "EventValue")}, outputs=["OutLeft", "OutRight"])
    def body(rows, all):
        best = all.groupBy("EventUser").agg(F.max_by("entity", F.struct("EventValue", -F.col("entity"))).alias("best"))
        yield Spawn(rows.crossJoin(best).select("_keys", F.col("EventUser").alias("OutLeft"), F.col("best").alias("OutRight")), ("OutLeft", "OutRight"), slot="OutLeft")

    e = store(spark, [body], schema.events(spark, sf_dir))
    e.put(Demand=True)
    return spawned(e, user_id="OutLeft", event_id="OutRight")


INVERSE_SQL = "SELECT n_name AS nation, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS members FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"


def members_of(e: Engine) -> DataFrame:
    rows = e.read(Query(Entity(), "NationName", "NationMembers"))
    shown = F.array_join(F.transform("NationMembers", lambda m: m - F.lit(schema.CUSTOMER * 2**48)), ",")
    return rows.select(F.col("NationName").alias("nation"), shown.alias("members"))


@query(INVERSE_SQL)
def inverse_members(spark, sf_dir):
    return members_of(store(spark, [], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir)))


@query("SELECT CASE WHEN c_nationkey = 3 THEN 'NATION_4' ELSE n_name END AS nation, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS members FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def retarget_inverse(spark, sf_dir):
    """All edges of one target move to another: two lists change, one vanishes."""
    e = store(spark, [], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    e.settle()
    at = lambda n: F.lit(schema.NATION * 2**48 + n)
    e.update("InNation", F.when(F.col("value") == at(3), at(4)).otherwise(F.col("value")))
    return members_of(e)


@query("SELECT c_custkey AS cust, xor(c_nationkey::BIGINT, c_custkey) AS mark FROM customer")
def member_xor(spark, sf_dir):
    @system("mark", Query(Entity(), "NationKey", "NationCustomers"), Query(Entity(), "CustomerName", where=In("NationCustomers")), outputs=["OutLong"])
    def body(rows):
        own = col("p1.entity") - F.lit(schema.CUSTOMER * 2**48)
        yield write(rows, "OutLong", col("p0.NationKey").cast("long").bitwiseXOR(own), "p1.entity")

    e = store(spark, [body], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    return e.read(Query(Entity(), "OutLong")).select((F.col("entity") - F.lit(schema.CUSTOMER * 2**48)).alias("cust"), F.col("OutLong").alias("mark"))


# -- pipelines and fixed points -----------------------------------------


def file_rules(limit: int) -> list[System]:
    """Text to length and first line; long ones spawn a note with provenance."""

    @system("parse", Query(Entity(), "DocText"), outputs=["OutLong", "OutText"])
    def parse(rows):
        yield write(rows, "OutLong", byte_length(col("p0.DocText")))
        yield write(rows, "OutText", first_line(col("p0.DocText")))

    @system("long", Query(Entity(), "OutLong"), outputs=["Label", "OutLeft", "Origin"])
    def long(rows):
        over = rows.where(col("p0.OutLong") > limit)
        yield Spawn(over.select("_keys", F.format_string("file too long: %d bytes", col("p0.OutLong")).alias("Label"), col("p0.entity").alias("OutLeft")), ("Label", "OutLeft"), anchors="Origin")

    return [parse, long]


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, split_part(text, chr(10), 1) AS line FROM documents")
def pipeline_files(spark, sf_dir):
    e = store(spark, file_rules(4000), schema.documents(spark, sf_dir))
    return e.read(Query(Entity(), "OutLong", "OutText")).select(F.col("entity").alias("doc_id"), F.col("OutLong").alias("bytes"), F.col("OutText").alias("line"))


NOTES_SQL = "SELECT doc_id, 'file too long: ' || strlen(text) || ' bytes' AS note FROM documents WHERE strlen(text) > 4000"


@query(NOTES_SQL)
def pipeline_notes(spark, sf_dir):
    return spawned(store(spark, file_rules(4000), schema.documents(spark, sf_dir)), doc_id="OutLeft", note="Label")


@query("SELECT doc_id, 'file too long: ' || strlen(text) || ' bytes' AS note FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'short' ELSE text END AS text FROM documents) WHERE strlen(text) > 4000")
def derived_cleanup(spark, sf_dir):
    """A changed text takes its note with it."""
    e = store(spark, file_rules(4000), schema.documents(spark, sf_dir))
    e.settle()
    e.update("DocText", F.when(F.col("entity") % 10 == 0, F.lit("short")).otherwise(F.col("value")))
    return spawned(e, doc_id="OutLeft", note="Label")


def parity_rules() -> list[System]:
    @system("parity", Query(Entity(), "EventUser"), outputs=["OutLong"])
    def parity(rows):
        yield write(rows, "OutLong", F.pmod(col("p0.EventUser"), F.lit(2)))

    @system("name", Query(Entity(), "OutLong"), outputs=["OutText"])
    def name(rows):
        yield write(rows, "OutText", F.when(col("p0.OutLong") == 0, "even").otherwise("odd"))

    return [parity, name]


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS name FROM events")
def parity(spark, sf_dir):
    e = store(spark, parity_rules(), schema.events(spark, sf_dir))
    return e.read(Query(Entity(), "OutText")).select(F.col("entity").alias("event_id"), F.col("OutText").alias("name"))


@query("SELECT 'parity' AS rule, count(*) * 2 AS runs FROM events UNION ALL SELECT 'name', count(*) FROM events")
def identical_rerun(spark, sf_dir):
    """Every input changes, every output stays equal: the first rule runs twice a row, the next one once."""
    e = store(spark, parity_rules(), schema.events(spark, sf_dir))
    e.settle()
    e.update("EventUser", F.col("value") + 2)
    e.settle()
    p = e.profile()
    return spark.createDataFrame([(n, int(p[n]["runs"])) for n in ("parity", "name")], "rule string, runs long")


def double_rule() -> System:
    @system("double", Query(Entity(), "OrderTotal"), outputs=["OutDouble"])
    def body(rows):
        yield write(rows, "OutDouble", col("p0.OrderTotal") * 2)

    return body


@query("SELECT o_orderkey AS order_key, 2 * CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS doubled FROM orders")
def incremental_after_update(spark, sf_dir):
    e = store(spark, [double_rule()], schema.orders(spark, sf_dir))
    e.settle()
    e.update("OrderTotal", F.col("value") + 1, where=Eq("OrderPriority", "1-URGENT"))
    return e.read(Query(Entity(), "OrderKey", "OutDouble")).select(F.col("OrderKey").alias("order_key"), F.col("OutDouble").alias("doubled"))


@query("SELECT o_orderkey AS order_key FROM orders WHERE o_orderpriority = '1-URGENT'")
def changed_since(spark, sf_dir):
    e = store(spark, [double_rule()], schema.orders(spark, sf_dir))
    cursor = e.settle()
    e.update("OrderTotal", F.col("value") + 1, where=Eq("OrderPriority", "1-URGENT"))
    return e.changed_since(Query(Entity(), "OrderKey", "OutDouble"), cursor).select(F.col("OrderKey").alias("order_key"))


@query("SELECT 'drained' AS part, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'left', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def drain_remaining(spark, sf_dir):
    e = store(spark, [], schema.orders(spark, sf_dir))
    taken = e.drain(Query(Entity(), "OrderKey", where=Eq("OrderStatus", "F"))).agg(F.lit("drained").alias("part"), F.count("*").alias("n"))
    return taken.unionByName(e.read(Query(Entity(), "OrderKey")).agg(F.lit("left").alias("part"), F.count("*").alias("n")))


@query("SELECT c_name AS customer FROM customer WHERE c_acctbal >= 0")
def despawn_rows(spark, sf_dir):
    e = store(spark, [], schema.customers(spark, sf_dir))
    e.settle()
    poor = e.read(Query(Entity(), "Balance")).where("Balance < 0")
    e.despawn(poor.select("entity"))
    return e.read(Query(Entity(), "CustomerName")).select(F.col("CustomerName").alias("customer"))


@query("""WITH RECURSIVE tree(kind, id, path) AS (
    SELECT 1, r_regionkey::BIGINT, r_name FROM region
    UNION ALL
    SELECT kind + 1, child.id, path || '/' || child.name FROM tree JOIN (
        SELECT 1 AS above, n_regionkey::BIGINT AS parent, n_nationkey::BIGINT AS id, n_name AS name FROM nation
        UNION ALL SELECT 2, c_nationkey, c_custkey, c_name FROM customer
    ) child ON child.above = tree.kind AND child.parent = tree.id)
    SELECT path FROM tree""")
def tree_labels(spark, sf_dir):
    """Paths down a tree to a fixed point: the rule reads what it writes."""

    @system("nation", Query(Entity(), "Path", "RegionNations"), Query(Entity(), "Label", where=In("RegionNations")), outputs=["Path"])
    def nation(rows):
        yield write(rows, "Path", F.concat_ws("/", "`p0.Path`", "`p1.Label`"), "p1.entity")

    @system("customer", Query(Entity(), "Path", "NationCustomers"), Query(Entity(), "Label", where=In("NationCustomers")), outputs=["Path"])
    def customer(rows):
        yield write(rows, "Path", F.concat_ws("/", "`p0.Path`", "`p1.Label`"), "p1.entity")

    e = store(spark, [nation, customer], schema.regions(spark, sf_dir), schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    named = lambda t, kind, key, name: schema.read(spark, sf_dir, t).select(schema.kind_entity(kind, F.col(key)).alias("entity"), F.col(name).alias("value"))
    top = named("region", schema.REGION, "r_regionkey", "r_name")
    e.insert(Label=named("nation", schema.NATION, "n_nationkey", "n_name").union(named("customer", schema.CUSTOMER, "c_custkey", "c_name")), Path=top)
    return e.read(Query(Entity(), "Path")).select(F.col("Path").alias("path"))


@query("SELECT n_name AS nation, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal >= 9000 GROUP BY n_name")
def complete_after_evaluate(spark, sf_dir):
    """A rule of the complete phase sees all that the evaluate phase derived."""

    @system("rich", Query(Entity(), "InNation", where=Gte("Balance", 9000.0)), outputs=["OutLeft"])
    def rich(rows):
        yield write(rows, "OutLeft", col("p0.InNation"))

    @system("count", Query(Entity(), "NationName"), views={"all": Query(Entity(), "OutLeft")}, phase="complete", outputs=["OutLong"])
    def count(rows, all):
        n = all.groupBy(F.col("OutLeft").alias("at")).agg(F.count("*").alias("n"))
        yield write(rows.join(n, col("p0.entity") == F.col("at"), "left"), "OutLong", F.coalesce("n", F.lit(0)))

    e = store(spark, [rich, count], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    return e.read(Query(Entity(), "NationName", "OutLong")).select(F.col("NationName").alias("nation"), F.col("OutLong").alias("customers"))


@query("SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O'")
def settle_deferred_inserts(spark, sf_dir):
    """In the settle phase removals apply at once, inserts in the next settle."""

    @system("archive", Query(Entity(), "OrderStatus", "OrderTotal"), phase="settle", outputs=["OutDouble", "OrderStatus"])
    def body(rows):
        yield Remove("OrderStatus", rows.where(col("p0.OrderStatus") != "O").select("_keys", col("p0.entity").alias("entity")))
        yield write(rows.where(col("p0.OrderStatus") == "O"), "OutDouble", col("p0.OrderTotal"))

    e = store(spark, [body], schema.orders(spark, sf_dir))
    e.settle()
    early = e.last_settled(Query("OutDouble")).count()
    e.put(1, Label="wake")
    found = e.read(Query(Entity(), "OrderKey", "OutDouble", Read("OrderStatus")))
    return found.where(F.lit(early) == 0).select(F.col("OrderKey").alias("order_key"), F.col("OutDouble").alias("total"))


@query("SELECT doc_id, CASE WHEN regexp_matches(array_extract(text, 1), '[A-Za-z0-9_]') THEN regexp_extract(text, '^[A-Za-z0-9_]+') END AS word FROM documents")
def word_at_offset(spark, sf_dir):
    from ..plans.query import Entity as E

    rows = store(spark, [], schema.documents(spark, sf_dir)).read(Query(E(), "DocText"))
    return rows.select(F.col("entity").alias("doc_id"), word_at(F.col("DocText"), F.lit(0)).alias("word"))


@query("SELECT n_nationkey::BIGINT AS nation, count(*) AS customers, round(max(c_acctbal), 2) AS best FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def flagship(spark, sf_dir):
    """Members of each nation along the edges, their number and best balance: one rule joins, a view folds."""

    @system("own", Query(Entity(), "NationKey", "NationCustomers"), Query(Entity(), "Balance", where=In("NationCustomers")), outputs=["OutLeft"])
    def own(rows):
        yield write(rows, "OutLeft", col("p0.entity"), "p1.entity")

    @system("fold", Query(Entity(), "NationKey"), views={"all": Query(Entity(), "OutLeft", "Balance")}, phase="complete", outputs=["OutLong", "OutDouble"])
    def body(rows, all):
        held = rows.join(all.groupBy(F.col("OutLeft").alias("_at")).agg(F.count("*").alias("n"), F.max("Balance").alias("best")), col("p0.entity") == F.col("_at"))
        yield write(held, "OutLong", F.col("n"))
        yield write(held, "OutDouble", F.col("best"))

    e = store(spark, [own, body], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    found = e.read(Query(Entity(), "NationKey", "OutLong", "OutDouble"))
    return found.select(F.col("NationKey").cast("long").alias("nation"), F.col("OutLong").alias("customers"), F.round("OutDouble", 2).alias("best"))


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    """Events by Structured Streaming into the store; the settled facts equal those of a batch."""
    from ..storage import Storage
    from ..streaming.ingest import ingest

    e = store(spark, [])
    kept = Storage(spark)
    path = f"{sf_dir}/events.parquet"
    table = schema.read(spark, sf_dir, "events")
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", name).parquet(folder)
    ingest(e, stream, "event_id", f"{kept.root}/stream", EventType="event_type", EventValue="value").awaitTermination()
    return e.read(Query(Entity(), "EventType", "EventValue")).groupBy(F.col("EventType").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("EventValue"), 2).alias("total"))


# -- relationships, mutations, healing: each leaves rows that SQL can tell ----


EDGES_SQL = "SELECT n_name AS nation, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE {} GROUP BY n_name"


def counted_members(e: Engine) -> DataFrame:
    return e.read(Query(Entity(), "NationName", "NationCustomers")).select(F.col("NationName").alias("nation"), F.col("NationCustomers.n").alias("customers"))


@query(EDGES_SQL.format("c_acctbal >= 0"))
def retracted_edges(spark, sf_dir):
    """Edges that are removed leave the inverses of their targets."""
    e = store(spark, [], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    poor = e.read(Query(Entity(), "Balance")).where("Balance < 0")
    e.remove("InNation", poor.select("entity"))
    return counted_members(e)


@query(EDGES_SQL.format("n_regionkey <> 1"))
def removed_targets(spark, sf_dir):
    """With a target its edges go, and what joined along them."""
    e = store(spark, [], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    gone = e.read(Query(Entity(), "InRegion")).where(F.col("InRegion") == F.lit(schema.REGION * 2**48 + 1))
    e.despawn(gone.select("entity"))
    return counted_members(e)


@query("SELECT c_custkey AS cust, round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS balance FROM customer UNION ALL SELECT 0, count(*) + count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer")
def member_values(spark, sf_dir):
    """A member's value moves only its own pairs: the last row has the number of runs."""

    @system("held", Query(Entity(), "NationName", "NationCustomers"), Query(Entity(), "Balance", where=In("NationCustomers")), outputs=["OutDouble"])
    def body(rows):
        yield write(rows, "OutDouble", col("p1.Balance"), "p1.entity")

    e = store(spark, [body], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    e.settle()
    e.update("Balance", F.col("value") + 1, where=Eq("Segment", "BUILDING"))
    found = e.read(Query(Entity(), "OutDouble")).select((F.col("entity") - F.lit(schema.CUSTOMER * 2**48)).alias("cust"), F.round("OutDouble", 2).alias("balance"))
    return found.unionByName(spark.createDataFrame([(0, float(e.profile()["held"]["runs"]))], "cust long, balance double"))


@query("SELECT n_nationkey::BIGINT AS nation, CASE n_nationkey WHEN 3 THEN 'NEW' WHEN 4 THEN lower(n_name) ELSE n_name END AS name FROM nation UNION ALL SELECT -1, 'true,false,true'")
def compared_and_set(spark, sf_dir):
    """A value is set only if its revision is still the one seen; another by a function of what it is."""
    e = store(spark, [], schema.nations(spark, sf_dir))
    at = lambda n: schema.NATION * 2**48 + n
    seen = e.revision_of(at(3), "NationName")
    said = [e.compare_and_set(at(3), "NationName", "NEW", seen), e.compare_and_set(at(3), "NationName", "OLD", seen)]
    said.append(e.with_latest(at(4), "NationName", str.lower) is not None)
    found = e.read(Query(Entity(), "NationName")).select((F.col("entity") - F.lit(schema.NATION * 2**48)).alias("nation"), F.col("NationName").alias("name"))
    return found.unionByName(spark.createDataFrame([(-1, ",".join(str(x).lower() for x in said))], "nation long, name string"))


@query("SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_acctbal >= 5000) AS customers FROM nation")
def healed_views(spark, sf_dir):
    """A rule that viewed a table in the wave in which it was filled runs again."""

    @system("count", Query(Entity(), "NationName"), views={"all": Query(Entity(), "OutDouble")}, outputs=["OutLong"])
    def count(rows, all):
        yield write(rows.crossJoin(all.agg(F.count("*").alias("n"))), "OutLong", F.col("n"))

    @system("rich", Query(Entity(), "Balance", where=Gte("Balance", 5000.0)), outputs=["OutDouble"])
    def rich(rows):
        yield write(rows, "OutDouble", col("p0.Balance"))

    e = store(spark, [count, rich], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    return e.read(Query(Entity(), "NationName", "OutLong")).select(F.col("NationName").alias("nation"), F.col("OutLong").alias("customers"))


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def retired_pairs(spark, sf_dir):
    """Outputs of a pair go with its partner."""

    @system("named", Query(Entity(), "NationName", "NationCustomers"), Query(Entity(), "CustomerName", where=In("NationCustomers")), outputs=["OutText", "Label"])
    def body(rows):
        yield spawn(rows, OutText=col("p1.CustomerName"), Label=col("p0.NationName"))

    e = store(spark, [body], schema.nations(spark, sf_dir), schema.customers(spark, sf_dir))
    gone = e.read(Query(Entity(), "InRegion")).where(F.col("InRegion") == F.lit(schema.REGION * 2**48 + 2))
    e.despawn(gone.select("entity"))
    return spawned(e, customer="OutText", nation="Label")


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT 'runs', '50'")
def given_again(spark, sf_dir):
    """Outputs that something else removes are given again by the pairs that still hold."""

    @system("named", Query(Entity(), "RegionName", "RegionNations"), Query(Entity(), "NationName", where=In("RegionNations")), outputs=["OutText", "Label"])
    def body(rows):
        yield spawn(rows, OutText=col("p0.RegionName"), Label=col("p1.NationName"))

    e = store(spark, [body], schema.regions(spark, sf_dir), schema.nations(spark, sf_dir))
    e.remove("OutText", e.read(Query(Entity(), "OutText")).select("entity"))
    found = spawned(e, region="OutText", nation="Label")
    return found.unionByName(spark.createDataFrame([("runs", str(e.profile()["named"]["runs"]))], "region string, nation string"))


@query("SELECT user_id, max(value) AS best FROM events GROUP BY user_id")
def mutated_best(spark, sf_dir):
    """Each user's best value, raised in place by a rule that reads and writes it: own writes are no news."""
    from ..model import Component
    from ..plans.query import Mut

    best = Component("Best", "double", hash=True)

    @system("raise", Query(Entity(), Mut("Best"), "OutLong"), views={"all": Query(Entity(), "EventUser", "EventValue")}, outputs=["Best"])
    def body(rows, all):
        top = all.groupBy("EventUser").agg(F.max("EventValue").alias("top"))
        yield write(rows.join(top, col("p0.OutLong") == F.col("EventUser")), "Best", F.greatest(col("p0.Best"), F.col("top")))

    e = Engine(spark, [*schema.COMPONENTS, best], systems=[body], commit_limit=None)
    e.load(schema.events(spark, sf_dir))
    users = schema.read(spark, sf_dir, "events").select("user_id").distinct().select((-F.col("user_id") - 1).alias("entity"), "user_id")
    e.insert(OutLong=users.select("entity", F.col("user_id").alias("value")), Best=users.select("entity", F.lit(float("-inf")).alias("value")))
    return e.read(Query(Entity(), "OutLong", "Best")).select(F.col("OutLong").alias("user_id"), F.col("Best").alias("best"))
