"""The star-schema tables seen as a knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.model import Expression, Graph, Schema

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
STATUSES = ("F", "O", "P")


def star_schema() -> Schema:
    return Schema(
        subclass=[
            *((f"Segment_{s}", "Customer") for s in SEGMENTS), *((f"Status_{s}", "Order") for s in STATUSES),
            ("Customer", "Party"), ("Supplier", "Party"), ("Party", "DomainEntity"), ("Nation", "Place"), ("Region", "Place"), ("Place", "DomainEntity"),
            ("Region", "_onlyNations"), ("Supplier", "_onlyNations"),
        ],
        equivalent=[("Client", "Customer"), ("Buyer", "_buyer"), ("Party", "_party"), ("DomesticBuyer", "_domestic"), ("LocatedSupplier", "_locatedSupplier"), ("Purchaser", "_placedOrder"), ("NationMember", "_inSomeNation")],
        disjoint=[("Place", "Party"), ("Order", "Party")],
        subproperty=[("inNation", "locatedIn"), ("inRegion", "locatedIn")],
        inverse=[("placed", "placedBy")],
        domain=[("placedBy", "Order"), ("placed", "Customer"), ("inNation", "Party"), ("inRegion", "Nation"), ("locatedIn", "Located"), ("orderedFrom", "Order"), ("compatriotOf", "Supplier")],
        range=[("placedBy", "Customer"), ("inNation", "Nation"), ("inRegion", "Region")],
        symmetric=["compatriotOf"],
        transitive=["locatedIn"],
        functional=["placedBy"],
        chains=[(("placedBy", "inNation"), "orderedFrom"), (("inNation", "inRegion"), "partyRegion")],
        expressions={
            "_placedOrder": Expression("some", prop="placed", filler="Order"),
            "_buyer": Expression("and", ("Customer", "_placedOrder")),
            "_party": Expression("or", ("Customer", "Supplier")),
            "_onlyNations": Expression("all", prop="inNation", filler="Nation"),
            "_inSomeNation": Expression("some", prop="inNation", filler="Nation"),
            "_locatedSupplier": Expression("and", ("Supplier", "Located")),
            "_domestic": Expression("and", ("Buyer", "Party")),
        },
    )


def node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Individuals are ``table/key``; facts are projections of the tables, so filters and columns reach the scans."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customer, supplier, orders, nation, region, part, line = map(read, ("customer", "supplier", "orders", "nation", "region", "part", "lineitem"))
    types = [
        customer.select(node("customer", "c_custkey").alias("s"), F.concat(F.lit("Segment_"), "c_mktsegment").alias("c")),
        supplier.select(node("supplier", "s_suppkey").alias("s"), F.lit("Supplier").alias("c")),
        orders.select(node("order", "o_orderkey").alias("s"), F.concat(F.lit("Status_"), "o_orderstatus").alias("c")),
        nation.select(node("nation", "n_nationkey").alias("s"), F.lit("Nation").alias("c")),
        region.select(node("region", "r_regionkey").alias("s"), F.lit("Region").alias("c")),
        part.select(node("part", "p_partkey").alias("s"), F.concat(F.lit("Brand_"), "p_brand").alias("c")),
    ]
    # Compatriots are linked to the first of their nation, not as all pairs; one row a nation is broadcast.
    first = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("a"))
    pair = supplier.select("s_nationkey", F.col("s_suppkey").alias("b")).join(first, "s_nationkey").where("a < b")
    rel = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    relations = [
        rel(customer, node("customer", "c_custkey"), "inNation", node("nation", "c_nationkey")),
        rel(supplier, node("supplier", "s_suppkey"), "inNation", node("nation", "s_nationkey")),
        rel(nation, node("nation", "n_nationkey"), "inRegion", node("region", "n_regionkey")),
        rel(orders, node("order", "o_orderkey"), "placedBy", node("customer", "o_custkey")),
        rel(line.select("l_orderkey", "l_partkey").distinct(), node("order", "l_orderkey"), "hasPart", node("part", "l_partkey")),
        rel(line.select("l_orderkey", "l_suppkey").distinct(), node("order", "l_orderkey"), "suppliedBy", node("supplier", "l_suppkey")),
        rel(pair, node("supplier", "a"), "compatriotOf", node("supplier", "b")),
    ]
    return Graph(_union(types), _union(relations), star_schema())


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def core_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph without parts and order lines, for operators whose answers list every neighbour."""
    g = star_graph(spark, sf_dir)
    return Graph(g.types.where(~F.col("s").startswith("part/")), g.relations.where(~F.col("p").isin("hasPart", "suppliedBy")), g.schema)


# SQL of the same views, for the oracles; written against the tables alone.
KG_SQL = """
asserted_type(s, c) AS (
  SELECT 'customer/' || c_custkey, 'Segment_' || c_mktsegment FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'Supplier' FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, 'Status_' || o_orderstatus FROM orders
  UNION ALL SELECT 'nation/' || n_nationkey, 'Nation' FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, 'Region' FROM region),
asserted_rel(s, p, o) AS (
  SELECT 'customer/' || c_custkey, 'inNation', 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'inNation', 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'inRegion', 'region/' || n_regionkey FROM nation
  UNION ALL SELECT 'order/' || o_orderkey, 'placedBy', 'customer/' || o_custkey FROM orders
  UNION ALL SELECT 'supplier/' || a, 'compatriotOf', 'supplier/' || s_suppkey FROM supplier JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS a FROM supplier GROUP BY s_nationkey) ON s_nationkey = k AND a < s_suppkey),
compat(s, o) AS (SELECT s, o FROM asserted_rel WHERE p = 'compatriotOf' UNION SELECT o, s FROM asserted_rel WHERE p = 'compatriotOf'),
rel(s, p, o) AS (
  SELECT s, p, o FROM asserted_rel WHERE p <> 'compatriotOf'
  UNION SELECT s, 'compatriotOf', o FROM compat
  UNION SELECT o, 'placed', s FROM asserted_rel WHERE p = 'placedBy'
  UNION SELECT s, 'locatedIn', o FROM asserted_rel WHERE p IN ('inNation', 'inRegion')
  UNION SELECT a.s, 'locatedIn', b.o FROM asserted_rel a JOIN asserted_rel b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion'
  UNION SELECT a.s, 'partyRegion', b.o FROM asserted_rel a JOIN asserted_rel b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion'
  UNION SELECT a.s, 'orderedFrom', b.o FROM asserted_rel a JOIN asserted_rel b ON a.o = b.s WHERE a.p = 'placedBy' AND b.p = 'inNation'),
subclass_of(sub, sup) AS (
  SELECT 'Segment_' || x, 'Customer' FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) v(x)
  UNION ALL SELECT 'Status_' || x, 'Order' FROM (VALUES ('F'), ('O'), ('P')) v(x)
  UNION ALL SELECT * FROM (VALUES ('Customer', 'Party'), ('Supplier', 'Party'), ('Party', 'DomainEntity'), ('Nation', 'Place'), ('Region', 'Place'), ('Place', 'DomainEntity')) v(a, b)),
domain_of(p, c) AS (VALUES ('placedBy', 'Order'), ('placed', 'Customer'), ('inNation', 'Party'), ('inRegion', 'Nation'), ('locatedIn', 'Located'), ('orderedFrom', 'Order'), ('compatriotOf', 'Supplier')),
range_of(p, c) AS (VALUES ('placedBy', 'Customer'), ('inNation', 'Nation'), ('inRegion', 'Region')),
typ(s, c) AS (
  SELECT s, c FROM asserted_type
  UNION SELECT s, 'Customer' FROM asserted_type WHERE c LIKE 'Segment_%'
  UNION SELECT s, 'Client' FROM asserted_type WHERE c LIKE 'Segment_%'
  UNION SELECT s, 'Order' FROM asserted_type WHERE c LIKE 'Status_%'
  UNION SELECT s, 'Party' FROM asserted_type WHERE c LIKE 'Segment_%' OR c = 'Supplier'
  UNION SELECT s, 'Place' FROM asserted_type WHERE c IN ('Nation', 'Region')
  UNION SELECT s, 'DomainEntity' FROM asserted_type WHERE c LIKE 'Segment_%' OR c IN ('Supplier', 'Nation', 'Region')
  UNION SELECT s, 'Located' FROM asserted_rel WHERE p IN ('inNation', 'inRegion')
  UNION SELECT o, x FROM asserted_rel, (VALUES ('Buyer'), ('DomesticBuyer'), ('Purchaser')) v(x) WHERE p = 'placedBy'
  UNION SELECT s, 'NationMember' FROM asserted_rel WHERE p = 'inNation'
  UNION SELECT s, 'LocatedSupplier' FROM asserted_rel WHERE p = 'inNation' AND s LIKE 'supplier/%')
"""


def kg_sql(tail: str) -> str:
    return f"WITH RECURSIVE {KG_SQL.strip()}\n{tail}"
