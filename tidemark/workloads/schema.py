"""Components over the star schema, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Component, Inverse, Shape
from ..sources.tables import Source, from_table, kind_entity

#: Kinds of entities, so that keys of several tables can live in one store.
REGION, NATION, CUSTOMER, ORDER, LINE = range(1, 6)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hashed(**types: str) -> list[Component]:
    return [Component(n, t, hash=True) for n, t in types.items()]


COMPONENTS = [
    *hashed(RegionName="string", NationName="string", RegionKey="int", NationKey="int", CustomerName="string", Segment="string", Balance="double"),
    *hashed(OrderPriority="string", OrderStatus="string", OrderTotal="double", OrderKey="long", Quantity="double", Price="double"),
    *hashed(EventType="string", EventUser="long", EventValue="double"),
    *hashed(DocText="string", DocLang="string", DocSource="string", DocChars="long", Quality="int", Toxic="int"),
    Component("InRegion", "long", hash=True, target="value"),
    Component("InNation", "long", hash=True, target="value"),
    Component("PlacedBy", "long", hash=True, target="value"),
    Inverse("RegionNations", edge="InRegion", lists=False),
    Inverse("NationCustomers", edge="InNation", lists=False),
    Inverse("CustomerOrders", edge="PlacedBy", lists=False),
    Inverse("NationMembers", edge="InNation"),
    Component("Origin", provenance=True),
    Component("Demand", "boolean", singleton=True),
    *hashed(OutText="string", OutLong="long", OutDouble="double", OutLeft="long", OutRight="long", Path="string", Label="string"),
]
SHAPES = [Shape("document", ("DocText", "DocLang"), ("Quality", "Toxic")), Shape("labelled", ("DocText", "Quality"))]


def regions(spark: SparkSession, sf_dir: str) -> Source:
    key = F.col("r_regionkey")
    return from_table(read(spark, sf_dir, "region"), kind_entity(REGION, key), RegionName="r_name", RegionKey=key)


def nations(spark: SparkSession, sf_dir: str) -> Source:
    key = F.col("n_nationkey")
    return from_table(read(spark, sf_dir, "nation"), kind_entity(NATION, key), NationName="n_name", NationKey=key, InRegion=kind_entity(REGION, F.col("n_regionkey")))


def customers(spark: SparkSession, sf_dir: str) -> Source:
    return from_table(read(spark, sf_dir, "customer"), kind_entity(CUSTOMER, F.col("c_custkey")), CustomerName="c_name", Segment="c_mktsegment", Balance="c_acctbal", InNation=kind_entity(NATION, F.col("c_nationkey")))


def orders(spark: SparkSession, sf_dir: str) -> Source:
    key = F.col("o_orderkey")
    return from_table(read(spark, sf_dir, "orders"), kind_entity(ORDER, key), OrderPriority="o_orderpriority", OrderStatus="o_orderstatus", OrderTotal="o_totalprice", OrderKey=key, PlacedBy=kind_entity(CUSTOMER, F.col("o_custkey")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines have no key of their own: the entity is that of order, line number and rank among the lines of both, so no two share one."""
    df = read(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    # lines are the last kind, so their keys may go on beyond those of the others: 44 bits of order, 4 of line, 12 of rank
    row = F.shiftleft(F.col("l_orderkey").cast("long"), 16) + F.shiftleft(F.col("l_linenumber").cast("long"), 12) + nth
    return df.select(kind_entity(LINE, row).alias("entity"), "l_orderkey", "l_quantity", "l_extendedprice")


def events(spark: SparkSession, sf_dir: str) -> Source:
    return from_table(read(spark, sf_dir, "events"), "event_id", EventType="event_type", EventUser="user_id", EventValue="value")


def documents(spark: SparkSession, sf_dir: str) -> Source:
    return from_table(read(spark, sf_dir, "documents"), "doc_id", DocText="text", DocLang="lang", DocSource="source", DocChars="n_chars")


def labels(spark: SparkSession, sf_dir: str) -> Source:
    return from_table(read(spark, sf_dir, "labels"), "doc_id", Quality="quality", Toxic="toxic")
