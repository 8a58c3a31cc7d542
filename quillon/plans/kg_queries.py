"""Queries over the star-schema graph: sizes, hops, rules, closures, clashes, explanations, tags and questions.

Each has SQL of its own over the tables (``SQL``), written apart from the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import brief as B
from quillon.operators import explain as X
from quillon.operators import hops as H
from quillon.operators import questions as Q
from quillon.operators import reasoning as R
from quillon.operators import tags as T
from quillon.operators.model import Expression, Graph, Schema
from quillon.operators.star import core_graph, kg_sql, star_graph
from quillon.plans.lineage import release, settle


_ENTAILED: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """The tables' files with sizes and times: what the entailed facts were derived from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return (spark.sparkContext.applicationId, sf_dir, *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def materialized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entailed named types and relations, derived anew."""
    g = core_graph(spark, sf_dir)
    m = R.materialize(g)
    return settle(R.named_types(g, m.types).select("s", "c")), settle(m.relations.select("s", "p", "o"))


def facts(spark: SparkSession, sf_dir: str) -> X.Facts:
    """Asserted and entailed facts; the entailed ones are kept for the last few states of the tables, then deleted."""
    g = core_graph(spark, sf_dir)
    state = _state(spark, sf_dir)
    if state not in _ENTAILED:
        for old in [k for k in _ENTAILED if k[:2] == state[:2]]:
            release(*_ENTAILED.pop(old))
        _ENTAILED[state] = materialized(spark, sf_dir)
    typ, rel = _ENTAILED[state]
    return X.Facts(g, g.types, g.relations, typ, rel)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# -- sizes and hops ----------------------------------------------------------------------------------------------------


@query("tbox_abox_size", "SELECT kind, n FROM (SELECT 'individuals' AS kind, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM part) AS n UNION ALL SELECT 'classes', CAST(23 AS BIGINT) UNION ALL SELECT 'properties', CAST(10 AS BIGINT))")
def tbox_abox_size(spark, d):
    return H.sizes(star_graph(spark, d))


@query("hop1_abox", kg_sql("SELECT x, count(*) AS n_axioms FROM (SELECT s AS x, p, s, o FROM asserted_rel UNION SELECT o, p, s, o FROM asserted_rel UNION SELECT t.s, 'rdf:type', t.s, t.c FROM asserted_type t) GROUP BY x"))
def hop1_abox(spark, d):
    return H.hop(core_graph(spark, d), 1).groupBy("x").agg(F.count("*").alias("n_axioms"))


_HOP2 = """, ax(id, i) AS (SELECT p || '|' || s || '|' || o, s FROM asserted_rel UNION SELECT p || '|' || s || '|' || o, o FROM asserted_rel UNION SELECT 'rdf:type|' || s || '|' || c, s FROM asserted_type)"""


@query("hop2_abox", kg_sql("SELECT x, count(*) AS n_axioms FROM (SELECT DISTINCT n.x, d.id FROM (SELECT DISTINCT a.i AS x, b.i AS y FROM ax a JOIN ax b ON a.id = b.id) n JOIN ax d ON n.y = d.i) GROUP BY x").replace("\nSELECT x, count", _HOP2 + "\nSELECT x, count", 1))
def hop2_abox(spark, d):
    return H.hop2_counts(core_graph(spark, d))


@query("hop3_bfs", kg_sql("SELECT x, count(*) AS n_reached FROM (SELECT DISTINCT 'region/' || r_regionkey AS x, 'region/' || r_regionkey AS y FROM region UNION SELECT 'region/' || n_regionkey, 'nation/' || n_nationkey FROM nation UNION SELECT 'region/' || n_regionkey, 'customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'region/' || n_regionkey, 'supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'region/' || n_regionkey, 'order/' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY x"))
def hop3_bfs(spark, d):
    g = core_graph(spark, d)
    start = g.types.where("c = 'Region'").select(F.col("s").alias("x"))
    return H.reach(g, start, 3).groupBy("x").agg(F.count("*").alias("n_reached"))


# -- rules and closures ------------------------------------------------------------------------------------------------


@query("closure_transitive", kg_sql("SELECT s, p, o FROM rel WHERE p = 'locatedIn'"))
def closure_transitive(spark, d):
    g = core_graph(spark, d)
    return R.transitive_closure(g, R.sub_property(g, g.relations).unionByName(g.relations))


@query("rule_subproperty", kg_sql("SELECT s, 'locatedIn' AS p, o FROM asserted_rel WHERE p IN ('inNation', 'inRegion')"))
def rule_subproperty(spark, d):
    g = core_graph(spark, d)
    return R.sub_property(g, g.relations)


@query("rule_inverse", kg_sql("SELECT o AS s, 'placed' AS p, s AS o FROM asserted_rel WHERE p = 'placedBy'"))
def rule_inverse(spark, d):
    g = core_graph(spark, d)
    return R.inverse(g, g.relations)


@query("rule_symmetric", kg_sql("SELECT o AS s, p, s AS o FROM asserted_rel WHERE p = 'compatriotOf'"))
def rule_symmetric(spark, d):
    g = core_graph(spark, d)
    return R.symmetric(g, g.relations)


@query("rule_chain", kg_sql("SELECT s, p, o FROM rel WHERE p IN ('orderedFrom', 'partyRegion')"))
def rule_chain(spark, d):
    g = core_graph(spark, d)
    return R.chain(g, g.relations)


@query("rule_domain", kg_sql("SELECT DISTINCT r.s, d.c FROM rel r JOIN domain_of d ON r.p = d.p"))
def rule_domain(spark, d):
    f = facts(spark, d)
    return R.domain(f.g, f.rel)


@query("rule_range", kg_sql("SELECT DISTINCT r.o AS s, d.c FROM rel r JOIN range_of d ON r.p = d.p"))
def rule_range(spark, d):
    f = facts(spark, d)
    return R.range_(f.g, f.rel)


@query("rule_union", kg_sql("SELECT DISTINCT s, '_party' AS c FROM typ WHERE c IN ('Customer', 'Supplier')"))
def rule_union(spark, d):
    f = facts(spark, d)
    return R.union_of(f.g, f.typ)


@query("rule_intersection", kg_sql("SELECT DISTINCT a.s, '_domestic' AS c FROM typ a JOIN typ b ON a.s = b.s WHERE a.c = 'Buyer' AND b.c = 'Party' UNION SELECT a.s, '_locatedSupplier' FROM typ a JOIN typ b ON a.s = b.s WHERE a.c = 'Supplier' AND b.c = 'Located'"))
def rule_intersection(spark, d):
    f = facts(spark, d)
    return R.intersection_of(f.g, f.typ)


@query("rule_some", kg_sql("SELECT DISTINCT r.s, '_placedOrder' AS c FROM rel r JOIN typ t ON r.o = t.s WHERE r.p = 'placed' AND t.c = 'Order' UNION SELECT DISTINCT r.s, '_inSomeNation' FROM rel r JOIN typ t ON r.o = t.s WHERE r.p = 'inNation' AND t.c = 'Nation'"))
def rule_some(spark, d):
    f = facts(spark, d)
    return R.some_values(f.g, f.typ, f.rel)


@query("rule_all", kg_sql("SELECT DISTINCT r.o AS s, 'Nation' AS c FROM rel r WHERE r.p = 'inNation' AND r.s LIKE 'supplier/%'"))
def rule_all(spark, d):
    f = facts(spark, d)
    members = f.typ.where("c = 'Supplier'").select("s", F.lit("_onlyNations").alias("c"))
    return R.all_values(f.g, members, f.rel)


@query("rule_functional_sameas", "SELECT DISTINCT 'part/' || m AS a, 'part/' || l_partkey AS b FROM lineitem JOIN (SELECT l_orderkey AS k, min('part/' || l_partkey) AS x, CAST(substr(min('part/' || l_partkey), 6) AS BIGINT) AS m FROM lineitem GROUP BY l_orderkey) ON l_orderkey = k WHERE l_partkey <> m")
def rule_functional_sameas(spark, d):
    """Which parts a functional hasPart would make equal: each with the smallest of its order."""
    from dataclasses import replace

    g = star_graph(spark, d)
    g.schema = replace(g.schema, functional=["hasPart"])
    return R.functional_same(g, g.relations)


@query("rule_sameas_components", "WITH RECURSIVE e(a, b) AS (SELECT s_nationkey, s_suppkey FROM supplier), m AS (SELECT s_nationkey AS k, min('supplier/' || s_suppkey) AS r FROM supplier GROUP BY s_nationkey HAVING count(*) > 1) SELECT 'supplier/' || s_suppkey AS s, r FROM supplier JOIN m ON s_nationkey = k")
def rule_sameas_components(spark, d):
    g = core_graph(spark, d)
    return R.representatives(g.relations.where("p = 'compatriotOf'").select(F.col("s").alias("a"), F.col("o").alias("b")))


@query("rule_reflexive", kg_sql("SELECT DISTINCT s, 'locatedIn' AS p, s AS o FROM asserted_type"))
def rule_reflexive(spark, d):
    from dataclasses import replace

    g = core_graph(spark, d)
    g.schema = replace(g.schema, reflexive=["locatedIn"])
    return R.reflexive(g, g.types.select("s").distinct())


def _sellers(spark, d) -> Graph:
    """Suppliers of a nation are forced equal by a functional property, and each sells its parts."""
    line, supplier = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "supplier"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    sells = line.select(name("supplier", "l_suppkey").alias("s"), F.lit("sells").alias("p"), name("part", "l_partkey").alias("o")).distinct()
    has = supplier.select(name("nation", "s_nationkey").alias("s"), F.lit("hasSupplier").alias("p"), name("supplier", "s_suppkey").alias("o"))
    types = supplier.select(name("supplier", "s_suppkey").alias("s"), F.lit("Supplier").alias("c"))
    apart = supplier.select(name("nation", "s_nationkey").alias("axiom"), name("supplier", "s_suppkey").alias("s"))
    return Graph(types, sells.unionByName(has), Schema(functional=["hasSupplier"]), None, apart)


@query("rule_sameas_substitution", "SELECT DISTINCT 'supplier/' || b.s_suppkey AS s, 'sells' AS p, 'part/' || l_partkey AS o FROM lineitem JOIN supplier a ON l_suppkey = a.s_suppkey JOIN supplier b ON a.s_nationkey = b.s_nationkey UNION ALL SELECT 'nation/' || s_nationkey, 'hasSupplier', 'supplier/' || s_suppkey FROM supplier")
def rule_sameas_substitution(spark, d):
    """RSN-11: equal suppliers share what each of them sells."""
    return R.materialize(_sellers(spark, d), equality=True).relations.select("s", "p", "o")


@query("clash_same_different", "SELECT 'same_and_different' AS rule, min('supplier/' || s_suppkey) AS a, max('supplier/' || s_suppkey) AS b FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def clash_same_different(spark, d):
    """RSN-20 where the suppliers of a nation are told apart and forced equal."""
    m = R.materialize(_sellers(spark, d), equality=True)
    return R.clashes(m, m.types, m.relations, m.same)


@query("rule_existential", kg_sql("SELECT t.s, 'placed' AS p, '_:' || t.s || '|_placedOrder' AS o FROM typ t WHERE t.c = 'Party' AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.s = t.s AND r.p = 'placed')"))
def rule_existential(spark, d):
    """RSN-21 for Party below (some placed.Order): witnesses of the parties without an order, suppliers among them."""
    from dataclasses import replace

    f = facts(spark, d)
    f.g.schema = replace(f.g.schema, subclass=[("Party", "_placedOrder")], equivalent=[])
    return R.skolems(f.g, f.typ, f.rel)[0]


@query("entailed_types", kg_sql("SELECT s, c FROM typ"))
def entailed_types(spark, d):
    return facts(spark, d).typ


@query("entailed_relations", kg_sql("SELECT s, p, o FROM rel"))
def entailed_relations(spark, d):
    return facts(spark, d).rel


@query("is_entailed", kg_sql("SELECT s, p, o FROM rel WHERE p = 'locatedIn' AND o = 'region/' || (length(s) % 5) UNION SELECT s, 'rdf:type', c FROM typ WHERE c = 'Party'"))
def is_entailed(spark, d):
    """Whether each individual lies in one region, which its name's length chooses, and is a Party."""
    f = facts(spark, d)
    s = f.a_typ.select("s").distinct()
    ask = s.select("s", F.lit("locatedIn").alias("p"), F.concat(F.lit("region/"), (F.length("s") % 5).cast("string")).alias("o"))
    return R.is_entailed(f.typ, f.rel, ask.unionByName(s.select("s", F.lit("rdf:type").alias("p"), F.lit("Party").alias("o"))))


@query("clash_disjoint", kg_sql("SELECT 'disjoint_classes' AS rule, 'nation/' || n_nationkey AS a, 'Place|Party' AS b FROM nation WHERE n_nationkey % 5 = 0"))
def clash_disjoint(spark, d):
    """Every fifth nation is also called a Party, which is disjoint from Place."""
    f = facts(spark, d)
    wrong = f.a_typ.where("c = 'Nation' and cast(split(s, '/')[1] as int) % 5 = 0").select("s", F.lit("Party").alias("c"))
    return R.clashes(f.g, f.typ.unionByName(wrong), f.rel)


@query("consistent_graphs", "SELECT 'nation/' || c_nationkey AS graph_id, 'customer/' || c_custkey AS s FROM customer WHERE c_nationkey % 5 <> 0")
def consistent_graphs(spark, d):
    """FLT-15: customers by nation, a graph each; graphs with a clash go."""
    g = core_graph(spark, d)
    rows = g.relations.where("p = 'inNation' and s like 'customer/%'").select(F.col("o").alias("graph_id"), "s")
    return R.keep_consistent(rows, clash_disjoint(spark, d).select(F.col("a").alias("graph_id")))


# -- explanations ------------------------------------------------------------------------------------------------------


def flat(paths: DataFrame) -> DataFrame:
    return paths.select("s", "p", "o", "type", "complexity", F.array_join("justifications", "; ").alias("justification"))


def _sql_type(body: str, kind: str, n: int, said: str, s: str = "s", o: str = "o") -> str:
    """SQL of a class strategy: rows of body, its justification, targets entailed."""
    return f"SELECT DISTINCT q.s, 'rdf:type' AS p, q.o, '{kind}' AS type, CAST({n} AS INTEGER) AS complexity, q.j AS justification FROM (SELECT {s} AS s, {o} AS o, {said} AS j FROM ({body}) b) q JOIN typ e ON e.s = q.s AND e.c = q.o"


_EQ = "(VALUES ('Client', 'Customer'), ('Customer', 'Client')) e(c, d)"
_INV = "(VALUES ('placed', 'placedBy'), ('placedBy', 'placed')) i(p, q)"
_MIN = "(SELECT s, p, min(o) AS v FROM rel GROUP BY s, p) r JOIN domain_of d ON r.p = d.p"
_PATHS = """, edge(a, b, eq) AS (SELECT sub, sup, false FROM subclass_of UNION ALL SELECT c, d, true FROM (VALUES ('Client', 'Customer'), ('Customer', 'Client')) v(c, d)),
walk(a, b, nodes, eqs) AS (SELECT a, b, [a, b], [eq] FROM edge {only} UNION ALL SELECT w.a, e.b, list_append(w.nodes, e.b), list_append(w.eqs, e.eq) FROM walk w JOIN (SELECT * FROM edge {only}) e ON w.b = e.a WHERE NOT list_contains(w.nodes, e.b) AND len(w.nodes) < {most})"""


def _walk_sql(most: int, subclass_only: bool, tail: str) -> str:
    only = "WHERE NOT eq" if subclass_only else ""
    return kg_sql("@@" + tail).replace("\n@@", _PATHS.format(only=only, most=most) + "\n")


EXPLAIN_SQL = {
    "EXP-1": kg_sql(_sql_type("SELECT t.s, t.c, x.sup FROM typ t JOIN subclass_of x ON t.c = x.sub", "SUBSUMPTION", 2, "s || ' rdf:type ' || c || '; ' || c || ' SubClassOf ' || sup", o="sup")),
    "EXP-2": kg_sql(_sql_type(f"SELECT t.s, t.c, e.d FROM typ t JOIN {_EQ} ON t.c = e.c", "EQUIVALENT_CLASS", 2, "s || ' rdf:type ' || c || '; ' || c || ' EquivalentTo ' || d", o="d")),
    "EXP-3": kg_sql(_sql_type(f"SELECT r.s, r.p, r.v, d.c FROM {_MIN}", "DOMAIN_RANGE", 2, "s || ' ' || p || ' ' || v || '; ' || p || ' Domain ' || c", o="c")),
    "EXP-4": kg_sql(_sql_type("SELECT r.o, r.p, min(r.s) AS y, d.c FROM rel r JOIN range_of d ON r.p = d.p GROUP BY r.o, r.p, d.c", "DOMAIN_RANGE", 2, "y || ' ' || p || ' ' || o || '; ' || p || ' Range ' || c", s="o", o="c")),
    "EXP-8": kg_sql(_sql_type("SELECT r.o, r.p, r.s AS y, d.c FROM asserted_rel r JOIN range_of d ON r.p = d.p", "DOMAIN_RANGE", 2, "y || ' ' || p || ' ' || o || '; ' || p || ' Range ' || c", s="o", o="c")),
    "EXP-9": _walk_sql(10, True, "SELECT DISTINCT t.s, 'rdf:type' AS p, w.b AS o, 'SUBSUMPTION' AS type, CAST(len(w.nodes) AS INTEGER) AS complexity, t.s || ' rdf:type ' || t.c || '; ' || array_to_string([w.nodes[k] || ' SubClassOf ' || w.nodes[k + 1] FOR k IN range(1, len(w.nodes))], '; ') AS justification FROM asserted_type t JOIN walk w ON t.c = w.a"),
    "EXP-10": _walk_sql(10, False, "SELECT t.s, 'rdf:type' AS p, w.b AS o, 'SUBSUMPTION' AS type, CAST(len(w.nodes) AS INTEGER) AS complexity, t.s || ' rdf:type ' || t.c || '; ' || array_to_string([w.nodes[k] || CASE WHEN w.eqs[k] THEN ' EquivalentTo ' ELSE ' SubClassOf ' END || w.nodes[k + 1] FOR k IN range(1, len(w.nodes))], '; ') AS justification FROM typ t JOIN (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY len(nodes), nodes) AS k FROM walk) w ON t.c = w.a AND w.k = 1"),
    "EXP-11": _walk_sql(11, False, "SELECT DISTINCT t.s, 'rdf:type' AS p, w.b AS o, 'SUBSUMPTION' AS type, CAST(len(w.nodes) AS INTEGER) AS complexity, t.s || ' rdf:type ' || w.nodes[len(w.nodes) - 1] || '; ' || array_to_string([w.nodes[k] || ' rdfs:subClassOf ' || w.nodes[k + 1] FOR k IN range(1, len(w.nodes))], '; ') AS justification FROM asserted_type t JOIN walk w ON t.c = w.a"),
    "EXP-12": _walk_sql(9, True, "SELECT DISTINCT t.s, 'rdf:type' AS p, w.b AS o, 'SUBSUMPTION' AS type, CAST(len(w.nodes) AS INTEGER) AS complexity, t.s || ' rdf:type ' || t.c || '; ' || array_to_string([w.nodes[k] || ' rdfs:subClassOf ' || w.nodes[k + 1] FOR k IN range(1, len(w.nodes))], '; ') AS justification FROM asserted_type t JOIN walk w ON t.c = w.a"),
    "EXP-14": kg_sql(_sql_type("SELECT a.s FROM asserted_type a JOIN typ l ON a.s = l.s AND l.c = 'Located' WHERE a.c = 'Supplier'", "INTERSECTION", 2, "s || ' rdf:type Supplier; Intersection satisfied: member of all 2 components'", o="'LocatedSupplier'")),
    "EXP-15": kg_sql(_sql_type("SELECT s, min(o) AS v FROM asserted_rel WHERE p = 'inNation' GROUP BY s", "EXISTENTIAL", 3, "s || ' inNation ' || v || '; ' || v || ' rdf:type Nation; some inNation.Nation restriction satisfied by ' || v", o="'NationMember'")),
    "EXP-16": kg_sql("SELECT 'region/' || r_regionkey AS s, 'rdf:type' AS p, 'Region' AS o, 'UNIVERSAL' AS type, CAST(1 AS INTEGER) AS complexity, 'No inNation values for region/' || r_regionkey || '; all inNation.Nation vacuously satisfied' AS justification FROM region UNION ALL SELECT s, 'rdf:type', 'Supplier', 'UNIVERSAL', 3, s || ' inNation ' || o || '; ' || o || ' rdf:type Nation; all inNation.Nation satisfied by all 1 values' FROM asserted_rel WHERE p = 'inNation' AND s LIKE 'supplier/%'"),
    "EXP-17": kg_sql(_sql_type(f"SELECT t.s, t.c, e.d FROM typ t JOIN {_EQ} ON t.c = e.c", "EQUIVALENT_CLASS", 2, "s || ' rdf:type ' || c || '; ' || c || ' owl:equivalentClass ' || d", o="d")),
    "EXP-18": kg_sql(_sql_type("SELECT r.s, r.p, min(r.o) AS v, x.f, x.d FROM rel r JOIN (VALUES ('placed', 'Order', 'Purchaser'), ('inNation', 'Nation', 'NationMember')) x(p, f, d) ON r.p = x.p GROUP BY r.s, r.p, x.f, x.d", "EXISTENTIAL", 3, "s || ' ' || p || ' ' || v || '; ' || v || ' rdf:type ' || f || '; some ' || p || '.' || f || ' restriction satisfied'", o="d") + " UNION ALL SELECT 'region/' || r_regionkey, 'rdf:type', 'Region', 'UNIVERSAL', CAST(1 AS INTEGER), 'No inNation values for region/' || r_regionkey || '; all inNation.Nation vacuously satisfied' FROM region"),
    "EXP-19": kg_sql(_sql_type(f"SELECT r.s, r.p, r.v, d.c FROM {_MIN}", "DOMAIN_RANGE", 2, "s || ' ' || p || ' ' || v || '; domain(' || p || ') = ' || c", o="c")),
    "EXP-20": kg_sql(_sql_type("SELECT a.s FROM typ a JOIN typ b ON a.s = b.s WHERE a.c = 'Buyer' AND b.c = 'Party'", "INTERSECTION", 3, "s || ' rdf:type Buyer; ' || s || ' rdf:type Party'", o="'DomesticBuyer'") + " UNION ALL " + _sql_type("SELECT a.s FROM typ a JOIN typ b ON a.s = b.s WHERE a.c = 'Located' AND b.c = 'Supplier'", "INTERSECTION", 3, "s || ' rdf:type Located; ' || s || ' rdf:type Supplier'", o="'LocatedSupplier'") + " UNION ALL " + _sql_type("SELECT s, min(c) AS c FROM typ WHERE c IN ('Customer', 'Supplier') GROUP BY s", "UNION", 2, "s || ' rdf:type ' || c || '; Union class membership via ' || c", o="'Party'")),
    "EXP-21": kg_sql(_sql_type("SELECT t.s, min(r.o) AS v FROM typ t JOIN rel r ON r.s = t.s AND r.p = 'placed' WHERE t.c = 'Customer' GROUP BY t.s", "INTERSECTION", 4, "s || ' rdf:type Customer; ' || s || ' placed ' || v || '; ' || v || ' rdf:type Order; Complex intersection satisfied (2 components)'", o="'Buyer'")),
    "EXP-22": kg_sql(_sql_type("SELECT a.s, a.o AS z, b.o AS v FROM rel a JOIN rel b ON a.o = b.s WHERE a.p = 'placedBy' AND b.p = 'inNation'", "PROPERTY_CHAIN", 4, "s || ' placedBy ' || z || '; ' || z || ' inNation ' || v || '; placedBy o inNation SubPropertyOf orderedFrom; orderedFrom Domain Order'", o="'Order'")),
    "EXP-23": kg_sql(_sql_type(f"SELECT r.o, i.p, i.q, min(r.s) AS y, d.c FROM rel r JOIN {_INV} ON r.p = i.q JOIN domain_of d ON i.p = d.p GROUP BY r.o, i.p, i.q, d.c", "INVERSE_PROPERTY", 3, "y || ' ' || q || ' ' || o || '; ' || p || ' InverseOf ' || q || '; ' || p || ' Domain ' || c", s="o", o="c")),
    "EXP-24": kg_sql(_sql_type("SELECT s, min(o) AS v FROM rel WHERE p = 'inNation' GROUP BY s", "FUNCTIONAL_PROPERTY", 3, "s || ' inNation ' || v || '; Functional: inNation; inNation Range Party'", o="'Party'")),
    "EXP-25": kg_sql(_sql_type("SELECT o, min(s) AS y FROM rel WHERE p = 'compatriotOf' AND s <> o GROUP BY o", "SYMMETRIC_PROPERTY", 3, "y || ' compatriotOf ' || o || '; Symmetric: compatriotOf; compatriotOf Domain Supplier'", s="o", o="'Supplier'")),
    "EXP-26": kg_sql(_sql_type("SELECT s, p, min(o) AS v FROM rel WHERE p IN ('inNation', 'inRegion') GROUP BY s, p", "SUBPROPERTY", 3, "s || ' ' || p || ' ' || v || '; ' || p || ' SubPropertyOf locatedIn; locatedIn Domain Located'", o="'Located'")),
    "EXP-27": kg_sql(_sql_type("SELECT r.o, r.p, r.s AS y, d.c FROM rel r JOIN range_of d ON r.p = d.p", "DOMAIN_RANGE", 2, "y || ' ' || p || ' ' || o || '; ' || p || ' Range ' || c", s="o", o="c")),
    "EXP-28": kg_sql(_sql_type("SELECT s, c FROM asserted_type", "DIRECT_ASSERTION", 1, "s || ' rdf:type ' || c || ' (direct assertion)'", o="c")),
    "EXP-30": kg_sql("SELECT DISTINCT s, p, o, 'DIRECT_ASSERTION' AS type, CAST(1 AS INTEGER) AS complexity, s || ' ' || p || ' ' || o AS justification FROM asserted_rel"),
    "EXP-31": kg_sql("SELECT DISTINCT s, 'locatedIn' AS p, o, 'SUBPROPERTY' AS type, CAST(2 AS INTEGER) AS complexity, s || ' ' || p || ' ' || o || '; ' || p || ' rdfs:subPropertyOf locatedIn' AS justification FROM rel WHERE p IN ('inNation', 'inRegion')"),
    "EXP-32": kg_sql("SELECT DISTINCT o AS s, p, s AS o, 'SYMMETRIC_PROPERTY' AS type, CAST(2 AS INTEGER) AS complexity, s || ' compatriotOf ' || o || '; SymmetricObjectProperty(compatriotOf)' AS justification FROM rel WHERE p = 'compatriotOf'"),
    "EXP-33": kg_sql("SELECT s, 'locatedIn' AS p, o, 'TRANSITIVE_PROPERTY' AS type, CAST(3 AS INTEGER) AS complexity, s || ' locatedIn ' || z || '; ' || z || ' locatedIn ' || o || '; TransitiveObjectProperty(locatedIn)' AS justification FROM (SELECT a.s, b.o, min(a.o) AS z FROM rel a JOIN rel b ON a.o = b.s WHERE a.p = 'locatedIn' AND b.p = 'locatedIn' AND a.o <> b.o GROUP BY a.s, b.o)"),
    "EXP-34": kg_sql(f"SELECT DISTINCT r.o AS s, i.p, r.s AS o, 'INVERSE_PROPERTY' AS type, CAST(2 AS INTEGER) AS complexity, r.s || ' ' || i.q || ' ' || r.o || '; ' || i.p || ' owl:inverseOf ' || i.q AS justification FROM rel r JOIN {_INV} ON r.p = i.q"),
    "EXP-35": kg_sql("SELECT s, p, o, 'PROPERTY_CHAIN' AS type, CAST(3 AS INTEGER) AS complexity, s || ' ' || p1 || ' ' || z || '; ' || z || ' ' || p2 || ' ' || o || '; PropertyChain(' || p1 || ' o ' || p2 || ') -> ' || p AS justification FROM (SELECT a.s, c.p1, c.p2, c.p, b.o, min(a.o) AS z FROM (VALUES ('placedBy', 'inNation', 'orderedFrom'), ('inNation', 'inRegion', 'partyRegion')) c(p1, p2, p) JOIN rel a ON a.p = c.p1 JOIN rel b ON b.p = c.p2 AND a.o = b.s GROUP BY a.s, c.p1, c.p2, c.p, b.o)"),
}
EXPLAIN_SQL["EXP-6"] = kg_sql(
    _sql_type(
        """SELECT s, c, min(k) AS k FROM (
  SELECT r.s, d.c, '1' || r.s || ' ' || r.p || ' ' || r.o || '; ' || r.p || ' Domain ' || d.c AS k, r.p FROM asserted_rel r JOIN domain_of d ON r.p = d.p
  UNION ALL SELECT r.s, 'Located', '2' || r.p || ' rdfs:subPropertyOf locatedIn; ' || r.s || ' ' || r.p || ' ' || r.o || '; locatedIn Domain Located', 'locatedIn' FROM asserted_rel r WHERE r.p IN ('inNation', 'inRegion')
  UNION ALL SELECT r.o, 'Customer', '3placed owl:inverseOf placedBy; ' || r.s || ' placedBy ' || r.o || '; placed Domain Customer', 'placed' FROM asserted_rel r WHERE r.p = 'placedBy'
  UNION ALL SELECT a.s, 'Order', '4PropertyChain(placedBy o inNation) -> orderedFrom; ' || a.s || ' placedBy ' || a.o || '; ' || a.o || ' inNation ' || b.o || '; orderedFrom Domain Order', 'orderedFrom' FROM asserted_rel a JOIN asserted_rel b ON a.o = b.s WHERE a.p = 'placedBy' AND b.p = 'inNation') GROUP BY s, c, p""",
        "DOMAIN_RANGE", 0, "substr(k, 2)", o="c",
    )
).replace("CAST(0 AS INTEGER)", "CAST(len(string_split(q.j, '; ')) AS INTEGER)")



def facts_for(spark, d, strategy: str) -> X.Facts:
    """The facts; for EXP-24 with inNation functional and of range Party, as its paths end at the subject's own class."""
    from dataclasses import replace

    f = facts(spark, d)
    if strategy == "EXP-24":
        f.g.schema = replace(f.g.schema, functional=["inNation"], range=[("inNation", "Party")])
    return f


for _id, _sql in EXPLAIN_SQL.items():
    query("explain_" + _id.replace("-", "_").lower(), _sql)(lambda spark, d, _id=_id: flat(X.explain(facts_for(spark, d, _id), _id)))

#: Strategies of the combined queries; few rows each, and every kind of overlap between them.
SOME = ["EXP-1", "EXP-9", "EXP-10", "EXP-12", "EXP-3", "EXP-19", "EXP-28"]
SIZED = [s for s in EXPLAIN_SQL if s != "EXP-24"]  # all that work on the graph's own schema
_ALL_SQL = " UNION ALL ".join(f"SELECT '{s}' AS strategy, * FROM ({EXPLAIN_SQL[s]})" for s in SIZED)


@query("explanation_size", f"SELECT s, p, o, min(complexity) AS min_size, max(complexity) AS max_size, count(*) AS explanation_count FROM ({_ALL_SQL}) GROUP BY s, p, o")
def explanation_size(spark, d):
    return X.sizes_of(facts(spark, d), SIZED)


_FIRST = " UNION ALL ".join(f"SELECT * FROM ({EXPLAIN_SQL[s]})" for s in ("EXP-1", "EXP-3", "EXP-28"))


@query("explain_dedup", f"SELECT s, p, o, type, max(complexity) AS complexity, count(*) AS n FROM ({_FIRST}) GROUP BY s, p, o, type")
def explain_dedup(spark, d):
    """Domain paths come twice, in two orders of the same axioms: one of each is left."""
    kept = X.deduplicate(X.explain_all(facts(spark, d), ["EXP-1", "EXP-3", "EXP-19", "EXP-28"]), ["type", "complexity"])
    return kept.groupBy("s", "p", "o", "type").agg(F.max("complexity").alias("complexity"), F.count("*").alias("n"))


# -- tags --------------------------------------------------------------------------------------------------------------

# The tag of a strategy's paths; where paths differ, by what their justification counts or says.
_H, _Q, _SUB = (f"(len(string_split(justification, '{x}')) - 1)" for x in (" SubClassOf ", " EquivalentTo ", " rdfs:subClassOf "))
_WALK = f"'D' || repeat('H', 2 * {_H}) || repeat('Q', {_Q}) || CASE WHEN {_H} > 0 AND {_Q} > 0 THEN 'M' ELSE '' END"
_VACUOUS = "CASE WHEN justification LIKE 'No %' THEN 'M' ELSE 'DD' END"
_TAGS = {
    "EXP-1": "'DHH'", "EXP-2": "'DQ'", "EXP-3": "'DR'", "EXP-4": "'DR'", "EXP-8": "'DR'", "EXP-9": _WALK, "EXP-10": _WALK, "EXP-11": f"'D' || repeat('H', {_SUB})", "EXP-12": f"'D' || repeat('H', {_SUB})",
    "EXP-14": "'D∩M'", "EXP-15": "'DD'", "EXP-16": _VACUOUS, "EXP-17": "'DQQ'", "EXP-18": _VACUOUS, "EXP-19": "'DR'", "EXP-20": "CASE WHEN justification LIKE '%Union %' THEN 'DDM' ELSE 'DD' END", "EXP-21": "'DDD∩M'",
    "EXP-22": "'DDHNRM'", "EXP-23": "'DIIRM'", "EXP-25": "'DSSRM'", "EXP-26": "'DHHRM'", "EXP-27": "'DR'", "EXP-28": "'D'", "EXP-30": "'D'", "EXP-31": "'DHH'", "EXP-32": "'DSS'", "EXP-33": "'DDTT'", "EXP-34": "'DII'", "EXP-35": "'DDNN'",
    "EXP-6": "CASE WHEN justification LIKE 'PropertyChain%' THEN 'DDNNRM' WHEN justification LIKE '%subPropertyOf%' THEN 'DHHRM' WHEN justification LIKE '%inverseOf%' THEN 'DIIRM' ELSE 'DR' END",
}
_TAGGED = " UNION ALL ".join(f"SELECT s, p, o, justification, {tag} AS tag FROM ({EXPLAIN_SQL[s]})" for s, tag in _TAGS.items())


def tagged(spark, d) -> B.Tagged:
    return B.tagged(facts(spark, d), [*_TAGS])


@query("tag_axioms", f"SELECT s, p, o, justification, tag FROM ({_TAGGED})")
def tag_axioms(spark, d):
    return tagged(spark, d).rows().select("s", "p", "o", "justification", "tag")


@query("tag_min_max", f"SELECT s, p, o, CAST(min(length(tag)) AS INTEGER) AS min_tag_len, CAST(max(length(tag)) AS INTEGER) AS max_tag_len FROM ({_TAGGED}) GROUP BY s, p, o")
def tag_min_max(spark, d):
    return tagged(spark, d).lengths()


_SHORT = f"SELECT s, p, o, min_by(replace(tag, 'D', ''), printf('%03d', length(replace(tag, 'D', ''))) || justification) AS shortest_tag FROM ({_TAGGED}) GROUP BY s, p, o"


@query("tag_shortest", _SHORT)
def tag_shortest(spark, d):
    return tagged(spark, d).shortest()


_GROUP_CASES = " ".join(f"CASE WHEN regexp_matches(shortest_tag, '[{letters}]') THEN '{name}' END," for name, letters in sorted(T.GROUPS.items())).rstrip(",")
_GROUPED = f"SELECT s, p, o, array_to_string(list_filter([{_GROUP_CASES}], lambda x: x IS NOT NULL), ',') AS tag_groups FROM ({_SHORT})"


@query("tag_groups", _GROUPED)
def tag_groups(spark, d):
    return tag_shortest(spark, d).select("s", "p", "o", F.array_join(T.groups_of(F.col("shortest_tag")), ",").alias("tag_groups"))


@query("tag_distribution", f"SELECT tag_group, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ({_SHORT})), 4) AS share FROM (SELECT unnest(string_split(tag_groups, ',')) AS tag_group FROM ({_GROUPED}) WHERE tag_groups <> '') GROUP BY tag_group")
def tag_distribution(spark, d):
    return T.distribution(tag_shortest(spark, d))


# -- questions ---------------------------------------------------------------------------------------------------------

_ROOT = "split_part(s, '/', 1)"
_INF = "SELECT s, 'rdf:type' AS p, c AS o FROM typ UNION ALL SELECT s, p, o FROM rel"
_SPARQL = lambda o: f"'<' || s || '> ' || CASE WHEN p = 'rdf:type' THEN 'rdf:type' ELSE '<' || p || '>' END || ' ' || {o}"


@query("ask_membership", kg_sql("SELECT '1hop-' || split_part(s, '/', 1) || '_' || s || '-' || s || '-rdf:type-BIN' AS task_id, split_part(s, '/', 1) AS root_entity, 'Membership' AS task_type, 'BIN' AS answer_type, 'ASK WHERE { <' || s || '> rdf:type <' || c || '> }' AS sparql_query, 'rdf:type' AS predicate, 'TRUE' AS answer FROM typ"))
def ask_membership(spark, d):
    f = facts(spark, d)
    inf = f.typ.select(F.split("s", "/")[0].alias("root"), "s", F.lit("rdf:type").alias("p"), F.col("c").alias("o"))
    return Q.ask(inf)


@query("questions_ask", kg_sql(f"SELECT '1hop-' || {_ROOT} || '_' || s || '-' || s || '-' || p || '-BIN' AS task_id, {_ROOT} AS root_entity, CASE WHEN p = 'rdf:type' THEN 'Membership' ELSE 'Property Assertion' END AS task_type, 'BIN' AS answer_type, 'ASK WHERE {{ ' || {_SPARQL(chr(39) + '<' + chr(39) + ' || o || ' + chr(39) + '>' + chr(39))} || ' }}' AS sparql_query, p AS predicate, 'TRUE' AS answer FROM ({_INF})"))
def questions_ask(spark, d):
    return Q.ask(Q.inferences(facts(spark, d)))


@query("questions_select", kg_sql(f"SELECT '1hop-' || {_ROOT} || '_' || s || '-' || s || '-' || p || '-MC' AS task_id, {_ROOT} AS root_entity, CASE WHEN p = 'rdf:type' THEN 'Membership' ELSE 'Property Assertion' END AS task_type, 'MC' AS answer_type, 'SELECT ?x WHERE {{ ' || {_SPARQL(chr(39) + '?x' + chr(39))} || ' }}' AS sparql_query, p AS predicate, string_agg(o, '; ' ORDER BY o) AS answer FROM (SELECT DISTINCT * FROM ({_INF})) GROUP BY s, p HAVING count(*) > 1"))
def questions_select(spark, d):
    return Q.select_(Q.inferences(facts(spark, d)))


@query("first_seen_dedup", "SELECT 'order/' || l_orderkey || '|hasPart|part/' || l_partkey AS triple_key, 'supplier/' || min(l_suppkey) AS graph FROM lineitem GROUP BY l_orderkey, l_partkey")
def first_seen_dedup(spark, d):
    """Order lines seen in their suppliers' graphs: each triple belongs to the first graph that shows it."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    seen = line.select(F.col("l_suppkey").alias("rank"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("graph"), Q.triple_key(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")), F.lit("hasPart"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))).alias("triple_key"))
    return Q.first_seen(seen, "triple_key", "rank", "graph")


@query("task_ids", "SELECT 'order/' || l_orderkey || '|hasPart|part/' || l_partkey AS triple_key, string_agg(DISTINCT '1hop-s' || l_suppkey || '_order/' || l_orderkey, ',' ORDER BY '1hop-s' || l_suppkey || '_order/' || l_orderkey) AS task_ids FROM lineitem GROUP BY l_orderkey, l_partkey")
def task_ids(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = line.select(Q.triple_key(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")), F.lit("hasPart"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))).alias("triple_key"), F.concat(F.lit("1hop-s"), F.col("l_suppkey").cast("string"), F.lit("_order/"), F.col("l_orderkey").cast("string")).alias("task_id"))
    return Q.task_ids(rows).select("triple_key", F.array_join("task_ids", ",").alias("task_ids"))


@query("tracker_stats", "SELECT 'supplier/' || k AS graph, count(*) AS n_first FROM (SELECT min(l_suppkey) AS k FROM lineitem GROUP BY l_orderkey, l_partkey) GROUP BY k")
def tracker_stats(spark, d):
    return first_seen_dedup(spark, d).groupBy("graph").agg(F.count("*").alias("n_first"))


# -- further rules, modules and parts of questions ---------------------------------------------------------------------


def _name(kind: str, c: str):
    return F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))


@query("rule_equivalent_property", "SELECT 'order/' || o_orderkey AS s, p, 'customer/' || o_custkey AS o FROM orders, (VALUES ('placedBy'), ('orderedBy')) v(p)")
def rule_equivalent_property(spark, d):
    g = core_graph(spark, d)
    g.schema = Schema(equivalent_property=[("placedBy", "orderedBy")])
    return R.apply_property_steps(g, g.relations.where("p = 'placedBy'"))


@query("rule_inverse_functional", "WITH m(n, s) AS (SELECT c_nationkey, 'customer/' || c_custkey FROM customer UNION ALL SELECT s_nationkey, 'supplier/' || s_suppkey FROM supplier) SELECT a, s AS b FROM m JOIN (SELECT n, min(s) AS a FROM m GROUP BY n) USING (n) WHERE s <> a")
def rule_inverse_functional(spark, d):
    """Whom an inverse functional inNation would make equal: all of a nation, each with the first."""
    g = core_graph(spark, d)
    g.schema = Schema(inverse_functional=["inNation"])
    return R.functional_same(g, g.relations)


@query("rule_has_self", "SELECT 'n/' || c_custkey AS s, '_self' AS c FROM customer WHERE c_custkey = c_nationkey UNION ALL SELECT 'n/' || s_suppkey, '_self' FROM supplier WHERE s_suppkey = s_nationkey AND s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey = c_nationkey)")
def rule_has_self(spark, d):
    c, s = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "supplier"))
    rel = c.select(_name("n", "c_custkey").alias("s"), F.lit("points").alias("p"), _name("n", "c_nationkey").alias("o")).unionByName(s.select(_name("n", "s_suppkey").alias("s"), F.lit("points").alias("p"), _name("n", "s_nationkey").alias("o")))
    g = Graph(rel.select("s", F.lit("N").alias("c")), rel, Schema(expressions={"_self": Expression("self", prop="points")}))
    return R.has_self(g, rel)


_FIRST_OF_NATION = "SELECT a, 'supplier/' || s_suppkey AS b FROM supplier JOIN (SELECT s_nationkey AS n, min('supplier/' || s_suppkey) AS a FROM supplier GROUP BY s_nationkey) ON s_nationkey = n WHERE a <> 'supplier/' || s_suppkey"


@query("rule_max_one", _FIRST_OF_NATION)
def rule_max_one(spark, d):
    """Suppliers of a nation that may have one at most."""
    g = _sellers(spark, d)
    g.schema = Schema(expressions={"_m": Expression("max", prop="hasSupplier", filler="Supplier", n=1)})
    nations = g.relations.where("p = 'hasSupplier'").select("s", F.lit("_m").alias("c"))
    return R.max_one_same(g, g.types.unionByName(nations.distinct()), g.relations)


@query("rule_keys", "WITH m AS (SELECT c_nationkey AS n, 'customer/' || c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING') SELECT a, s AS b FROM m JOIN (SELECT n, min(s) AS a FROM m GROUP BY n) USING (n) WHERE s <> a")
def rule_keys(spark, d):
    """Customers of one segment whose key would be their nation."""
    g = core_graph(spark, d)
    g.schema = Schema(keys=[("Segment_BUILDING", ("inNation",))])
    return R.key_same(g, g.types, g.relations)


@query("rule_value", "SELECT 'customer/' || c_custkey AS s, '_home' AS c FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier/' || s_suppkey, '_home' FROM supplier WHERE s_nationkey = 3")
def rule_value(spark, d):
    g = core_graph(spark, d)
    g.schema = Schema(expressions={"_home": Expression("value", prop="inNation", filler="nation/3")})
    return R.has_value(g, g.relations)


@query("module_radius", "SELECT 'region/' || r_regionkey AS x, 1 + 2 * (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_axioms FROM region")
def module_radius(spark, d):
    """FLT-3: modules of radius one around the regions: their nations, what types all of them, and what joins them."""
    g = core_graph(spark, d)
    start = g.types.where("c = 'Region'").select(F.col("s").alias("x"))
    return H.module(g, 1, start).groupBy("x").agg(F.count("*").alias("n_axioms"))


@query("module_with_schema", "SELECT x, n + 43 AS n_axioms FROM (SELECT 'region/' || r_regionkey AS x, 1 + 2 * (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region)")
def module_with_schema(spark, d):
    """JN-5: the same modules with the schema's 43 axioms in each."""
    g = core_graph(spark, d)
    start = g.types.where("c = 'Region'").select(F.col("s").alias("x"))
    return H.with_schema(g, H.module(g, 1, start)).groupBy("x").agg(F.count("*").alias("n_axioms"))


@query("root_of_classes", kg_sql("SELECT s, min(c) AS root_entity FROM typ GROUP BY s"))
def root_of_classes(spark, d):
    return Q.root_of_classes(facts(spark, d).typ, ["s"])


@query("discover_individuals", kg_sql("SELECT s FROM asserted_type UNION SELECT s FROM asserted_rel UNION SELECT o FROM asserted_rel"))
def discover_individuals(spark, d):
    from quillon.operators.verbalize import discover

    g = core_graph(spark, d)
    return discover(g.types, g.relations)


@query("build_query", "SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN 'ASK { ' ELSE 'SELECT ' || CASE WHEN c_custkey % 3 = 0 THEN '?s ?o' ELSE '?o' END || ' WHERE { ' END || CASE WHEN c_custkey % 3 = 0 THEN '?s' ELSE '<' || c_name || '>' END || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE '<p>' END || ' ' || CASE c_custkey % 5 WHEN 0 THEN '<http://x/' || c_nationkey || '>' WHEN 4 THEN '?o' ELSE '\"' || c_mktsegment || '\"' END || ' }' AS q FROM customer")
def build_query(spark, d):
    """PRJ-7: some parts missing, types, IRIs and literals."""
    k = F.col("c_custkey")
    s = F.when(k % 3 != 0, F.col("c_name"))
    p = F.when(k % 2 == 0, F.lit("rdf:type")).otherwise("p")
    o = F.when(k % 5 == 0, F.concat(F.lit("http://x/"), F.col("c_nationkey").cast("string"))).when(k % 5 != 4, F.col("c_mktsegment"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(k % 5 < 4, Q.build_query(s, p, o)).otherwise(Q.build_query(s, p, o, "SELECT")).alias("q"))


@query("axiom_texts", "SELECT n_nationkey, n_name || ' rdf:type Nation' AS t1, n_name || ' inRegion r' || n_regionkey AS t2, 'domain(inRegion) = ' || n_name AS t3, 'Irreflexive(' || n_name || ')' AS t4, 3 AS n3 FROM nation")
def axiom_texts(spark, d):
    """PRJ-11, AGG-23: plain forms of axioms, and the names in one."""
    from quillon.operators import reports as P

    n, r = F.col("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    said = lambda kind, *args: X.axiom_text(X.axiom(kind, *args))
    return spark.read.parquet(f"{d}/nation.parquet").select(
        "n_nationkey", said("ClassAssertion", F.lit("Nation"), n).alias("t1"), said("PropertyAssertion", F.lit("inRegion"), n, r).alias("t2"), said("Domain", F.lit("inRegion"), n).alias("t3"), said("Irreflexive", n).alias("t4"),
        P.occurrences(X.axiom("PropertyChain", F.lit("p"), F.lit("q"), n, F.lit("p"))).alias("n3"),
    )
