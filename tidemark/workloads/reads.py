"""Read queries: scans, parts, filters, arguments, several queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..plans.query import And, Entity, Eq, Gte, Named, Not, Optional, Or, Query, Tracked, With, Without
from . import schema

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def store(spark: SparkSession, *sources) -> Engine:
    e = Engine(spark, schema.COMPONENTS, schema.SHAPES)
    for s in sources:
        e.load(s)
    return e


def orders(spark: SparkSession, sf_dir: str, q: Query, **args) -> DataFrame:
    return store(spark, schema.orders(spark, sf_dir)).read(q, **args)


def docs(spark: SparkSession, sf_dir: str) -> Engine:
    return store(spark, schema.documents(spark, sf_dir), schema.labels(spark, sf_dir))


ORDER = Query(Entity(), "OrderKey", "OrderTotal")


def order_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("OrderKey").alias("order_key"), F.col("OrderTotal").alias("total"))


@query("SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders")
def scan_component(spark, sf_dir):
    return order_rows(orders(spark, sf_dir, ORDER))


@query("SELECT doc_id AS entity FROM documents UNION SELECT doc_id FROM labels")
def scan_entities(spark, sf_dir):
    return docs(spark, sf_dir).read(Query(Entity()))


@query("SELECT d.doc_id AS entity FROM documents d JOIN labels l USING (doc_id)")
def facet_rows(spark, sf_dir):
    return docs(spark, sf_dir).read(Query(Entity("labelled"))).select("entity")


@query("SELECT d.doc_id AS entity FROM documents d")
def tracked_shape(spark, sf_dir):
    return docs(spark, sf_dir).read(Query(Entity("document"), Tracked("document"))).select("entity")


@query("SELECT d.doc_id AS entity, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def optional_part(spark, sf_dir):
    return docs(spark, sf_dir).read(Query(Entity(), "DocLang", Optional("Quality"))).select("entity", F.col("DocLang").alias("lang"), F.col("Quality").alias("quality"))


@query("SELECT d.doc_id AS entity, d.n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def with_filter(spark, sf_dir):
    return docs(spark, sf_dir).read(Query(Entity(), "DocChars", where=With("Quality"))).select("entity", F.col("DocChars").alias("n_chars"))


@query("SELECT d.doc_id AS entity, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def without_filter(spark, sf_dir):
    return docs(spark, sf_dir).read(Query(Entity(), "DocChars", where=Without("Quality"))).select("entity", F.col("DocChars").alias("n_chars"))


@query("SELECT d.doc_id AS entity FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en'")
def and_plain(spark, sf_dir):
    return docs(spark, sf_dir).read(Query(Entity(), "DocLang", where=And(With("Quality"), Eq("DocLang", "en")))).select("entity")


@query("SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders WHERE o_orderpriority = '1-URGENT'")
def where_eq(spark, sf_dir):
    return order_rows(orders(spark, sf_dir, Query(Entity(), "OrderKey", "OrderTotal", where=Eq("OrderPriority")), OrderPriority="1-URGENT"))


@query("SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders WHERE o_totalprice >= 400000")
def where_gte(spark, sf_dir):
    return order_rows(orders(spark, sf_dir, Query(Entity(), "OrderKey", "OrderTotal", where=Gte("OrderTotal")), OrderTotal=400000.0))


@query("SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 250000")
def where_and(spark, sf_dir):
    return order_rows(orders(spark, sf_dir, Query(Entity(), "OrderKey", "OrderTotal", where=And(Eq("OrderPriority"), Gte("OrderTotal"))), OrderPriority="1-URGENT", OrderTotal=250000.0))


@query("SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders WHERE o_orderpriority = '5-LOW' OR o_totalprice >= 450000")
def where_or(spark, sf_dir):
    return order_rows(orders(spark, sf_dir, Query(Entity(), "OrderKey", "OrderTotal", where=Or(Eq("OrderPriority"), Gte("OrderTotal"))), OrderPriority="5-LOW", OrderTotal=450000.0))


@query("SELECT d.doc_id AS entity FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.quality = 1, false)")
def where_not_missing(spark, sf_dir):
    return docs(spark, sf_dir).read(Query(Entity(), "DocLang", where=Not(Eq("Quality", 1)))).select("entity")


@query("SELECT 'high' AS tag, o_orderkey AS order_key FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT 'low', o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'")
def named_multi(spark, sf_dir):
    q = Query(Entity(), "OrderKey", where=Eq("OrderPriority"))
    e = store(spark, schema.orders(spark, sf_dir))
    found = e.read(Named("high", q), Named("low", q), args_for={"high": {"OrderPriority": "2-HIGH"}, "low": {"OrderPriority": "5-LOW"}})
    high, low = (d.select(F.lit(t).alias("tag"), F.col("OrderKey").alias("order_key")) for d, t in zip(found, ("high", "low")))
    return high.unionByName(low)


@query("SELECT o_orderkey AS order_key, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ordered_top(spark, sf_dir):
    return order_rows(orders(spark, sf_dir, ORDER)).orderBy(F.desc("total"), "order_key").limit(25)


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def external_aggregate(spark, sf_dir):
    rows = orders(spark, sf_dir, Query(Entity(), "OrderStatus", "OrderPriority"))
    return rows.cube(F.col("OrderStatus").alias("status"), F.col("OrderPriority").alias("priority")).agg(F.count("*").alias("n"))
