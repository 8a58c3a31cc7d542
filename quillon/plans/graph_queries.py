"""Queries over many graphs and over vocabularies that are tables themselves: entailments and clashes by graph, closures of
class hierarchies, chains, descriptions of classes and properties.

Each has SQL of its own over the tables (``SQL``), written apart from the operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import closure as C
from quillon.operators import explain as X
from quillon.operators import graphs as M
from quillon.operators import hops as H
from quillon.operators import questions as Q
from quillon.operators import reasoning as R
from quillon.operators import verbalize as V
from quillon.plans.lineage import settle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _read(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def _name(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))


def _axiom(rows: DataFrame, kind: str, a: Column, b: Column | None = None, id_: Column | None = None, at: Column | None = None, n: Column | None = None, graph: Column | None = None) -> DataFrame:
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return rows.select((F.lit("kg") if graph is None else graph).alias("graph_id"), F.lit(kind).alias("kind"), none(id_, "string").alias("id"), a.cast("string").alias("a"), none(b, "string").alias("b"), none(at, "int").alias("at"), none(n, "int").alias("n"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- many graphs -------------------------------------------------------------------------------------------------------


def nation_graphs(spark: SparkSession, d: str) -> M.Graphs:
    """A graph for each nation: its customers, suppliers and orders, under names that other graphs use, too.

    Schemas differ: even nations have a super-property and a domain, odd ones an inverse and a chain, those of region 2 an
    equivalent class; in nation 3 customers are disjoint with one of their segments, which makes it inconsistent.
    """
    customer, supplier, orders, nation = _read(spark, d, "customer", "supplier", "orders", "nation")
    g, short = _name("nation", "c_nationkey"), F.concat(F.lit("c"), (F.col("c_custkey") % 500).cast("string"))
    placed = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_custkey", "c_nationkey"), "o_custkey")
    order = F.concat(F.lit("o"), (F.col("o_orderkey") % 900).cast("string"))
    types = _all([
        customer.select(g.alias("graph_id"), short.alias("s"), F.concat(F.lit("Segment_"), "c_mktsegment").alias("c")),
        supplier.select(_name("nation", "s_nationkey").alias("graph_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("s"), F.lit("Supplier").alias("c")),
    ])
    relations = _all([
        customer.select(g.alias("graph_id"), short.alias("s"), F.lit("inNation").alias("p"), F.lit("here").alias("o")),
        supplier.select(_name("nation", "s_nationkey").alias("graph_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("s"), F.lit("inNation").alias("p"), F.lit("here").alias("o")),
        placed.select(g.alias("graph_id"), order.alias("s"), F.lit("placedBy").alias("p"), short.alias("o")),
    ])
    n, k, lit = _name("nation", "n_nationkey"), F.col("n_nationkey"), F.lit
    segments = customer.select(g.alias("graph_id"), F.concat(lit("Segment_"), "c_mktsegment").alias("c")).distinct()
    axioms = _all([
        _axiom(segments, "subclass", F.col("c"), lit("Customer"), graph=F.col("graph_id")), _axiom(nation, "subclass", lit("Customer"), lit("Party"), graph=n), _axiom(nation, "subclass", lit("Supplier"), lit("Party"), graph=n),
        _axiom(nation.where("n_nationkey % 2 = 0"), "subproperty", lit("inNation"), lit("locatedIn"), graph=n), _axiom(nation.where("n_nationkey % 2 = 0"), "domain", lit("placedBy"), lit("Order"), graph=n),
        _axiom(nation.where("n_nationkey % 2 = 1"), "inverse", lit("placedBy"), lit("placed"), graph=n),
        *[_axiom(nation.where("n_nationkey % 2 = 1"), "chain", lit(link), lit("orderedFrom"), lit("c"), lit(at), lit(2), n) for at, link in enumerate(("placedBy", "inNation"))],
        _axiom(nation.where("n_regionkey = 2"), "equivalent", lit("Client"), lit("Customer"), graph=n),
        *[_axiom(nation.where(k == 3), "disjoint", lit(c), None, lit("d"), lit(at), lit(2), n) for at, c in enumerate(("Customer", "Segment_BUILDING"))],
    ])
    return M.many(types.distinct(), relations.distinct(), axioms)


_C, _O = "'c' || (c_custkey % 500)", "'o' || (o_orderkey % 900)"
_GRAPHS = f"""WITH t(graph_id, s, c) AS (SELECT 'nation/' || c_nationkey, {_C}, 'Segment_' || c_mktsegment FROM customer UNION SELECT 'nation/' || s_nationkey, 's' || s_suppkey, 'Supplier' FROM supplier),
r(graph_id, s, p, o) AS (SELECT 'nation/' || c_nationkey, {_C}, 'inNation', 'here' FROM customer UNION SELECT 'nation/' || s_nationkey, 's' || s_suppkey, 'inNation', 'here' FROM supplier UNION SELECT 'nation/' || c_nationkey, {_O}, 'placedBy', {_C} FROM orders JOIN customer ON o_custkey = c_custkey),
k(graph_id, k, region) AS (SELECT 'nation/' || n_nationkey, n_nationkey, n_regionkey FROM nation),
typ AS (SELECT * FROM t UNION SELECT graph_id, s, 'Customer' FROM t WHERE c LIKE 'Segment%' UNION SELECT graph_id, s, 'Party' FROM t UNION SELECT graph_id, s, 'Client' FROM t JOIN k USING (graph_id) WHERE c LIKE 'Segment%' AND region = 2 UNION SELECT graph_id, s, 'Order' FROM r JOIN k USING (graph_id) WHERE p = 'placedBy' AND k % 2 = 0),
rel AS (SELECT * FROM r UNION SELECT graph_id, s, 'locatedIn', o FROM r JOIN k USING (graph_id) WHERE p = 'inNation' AND k % 2 = 0 UNION SELECT graph_id, o, 'placed', s FROM r JOIN k USING (graph_id) WHERE p = 'placedBy' AND k % 2 = 1
  UNION SELECT a.graph_id, a.s, 'orderedFrom', b.o FROM r a JOIN r b ON a.graph_id = b.graph_id AND a.o = b.s JOIN k ON a.graph_id = k.graph_id WHERE a.p = 'placedBy' AND b.p = 'inNation' AND k % 2 = 1)"""
_CONSISTENT = "graph_id <> 'nation/3' OR NOT EXISTS (SELECT 1 FROM t x WHERE x.graph_id = 'nation/3' AND x.c = 'Segment_BUILDING')"

def _entailed(spark, d) -> tuple[M.Graphs, M.Graphs, DataFrame]:
    """The nations' graphs, what they entail, and the clashes."""
    g = nation_graphs(spark, d)
    m = R.materialize(g)
    return g, m, settle(R.clashes(m, m.types, m.relations))


@query("graphs_entailed", f"{_GRAPHS} SELECT graph_id, s, 'rdf:type' AS p, c AS o FROM typ WHERE {_CONSISTENT} UNION ALL SELECT * FROM rel WHERE {_CONSISTENT}")
def graphs_entailed(spark, d):
    """FLT-15: what each consistent graph entails; an inconsistent one leaves alone."""
    g, m, found = _entailed(spark, d)
    t = R.named_types(g, m.types).select("s", F.lit(Q.TYPE).alias("p"), F.col("c").alias("o"))
    return R.keep_consistent(M.own_names(t.unionByName(m.relations.select("s", "p", "o")), "s"), M.clashing(found))


@query("graphs_clashes", f"{_GRAPHS} SELECT DISTINCT graph_id, 'disjoint_classes' AS rule, s AS a, 'Customer|Segment_BUILDING' AS b FROM t WHERE graph_id = 'nation/3' AND c = 'Segment_BUILDING'")
def graphs_clashes(spark, d):
    return M.clashing(_entailed(spark, d)[2])


@query("graphs_sizes", f"""{_GRAPHS}, c AS (SELECT graph_id, count(DISTINCT c) AS n, count(DISTINCT CASE WHEN c LIKE 'Segment%' THEN c END) AS segments, count(DISTINCT CASE WHEN c = 'Supplier' THEN c END) AS sup FROM t GROUP BY graph_id)
SELECT graph_id, kind, CAST(n AS BIGINT) AS n FROM (
SELECT graph_id, 'tbox' AS kind, coalesce(segments, 0) + 2 + CASE WHEN k % 2 = 0 THEN 2 ELSE 2 END + CASE WHEN region = 2 THEN 1 ELSE 0 END + CASE WHEN k = 3 THEN 1 ELSE 0 END AS n FROM k LEFT JOIN c USING (graph_id)
UNION ALL SELECT graph_id, 'abox', (SELECT count(*) FROM t WHERE t.graph_id = k.graph_id) + (SELECT count(*) FROM r WHERE r.graph_id = k.graph_id) FROM k
UNION ALL SELECT graph_id, 'individuals', (SELECT count(*) FROM (SELECT s FROM t WHERE t.graph_id = k.graph_id UNION SELECT s FROM r WHERE r.graph_id = k.graph_id UNION SELECT o FROM r WHERE r.graph_id = k.graph_id)) FROM k
UNION ALL SELECT graph_id, 'classes', coalesce(segments, 0) + CASE WHEN k = 3 AND NOT EXISTS (SELECT 1 FROM t WHERE t.graph_id = k.graph_id AND t.c = 'Segment_BUILDING') THEN 1 ELSE 0 END + 3 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN region = 2 THEN 1 ELSE 0 END FROM k LEFT JOIN c USING (graph_id)
UNION ALL SELECT graph_id, 'properties', CASE WHEN k % 2 = 0 THEN 3 ELSE 4 END FROM k)""")
def graphs_sizes(spark, d):
    """AGG-1 by graph."""
    return M.graph_sizes(nation_graphs(spark, d))


@query("graphs_totals", f"SELECT kind, CAST(sum(n) AS BIGINT) AS n, round(avg(n), 4) AS mean FROM ({SQL['graphs_sizes']}) GROUP BY kind")
def graphs_totals(spark, d):
    """AGG-2"""
    return H.totals(graphs_sizes(spark, d))


@query("graphs_explained", f"""{_GRAPHS} SELECT graph_id, s, 'rdf:type' AS p, c AS o, 'EXP-28' AS strategy, s || ' rdf:type ' || c || ' (direct assertion)' AS said FROM t
UNION ALL SELECT graph_id, s, 'rdf:type', 'Customer', 'EXP-1', s || ' rdf:type ' || c || '; ' || c || ' SubClassOf Customer' FROM t WHERE c LIKE 'Segment%'
UNION ALL SELECT graph_id, s, 'rdf:type', 'Party', 'EXP-1', s || ' rdf:type ' || c || '; ' || c || ' SubClassOf Party' FROM typ WHERE c IN ('Customer', 'Supplier')
UNION ALL SELECT graph_id, s, 'rdf:type', 'Customer', 'EXP-9', s || ' rdf:type ' || c || '; ' || c || ' SubClassOf Customer' FROM t WHERE c LIKE 'Segment%'
UNION ALL SELECT graph_id, s, 'rdf:type', 'Party', 'EXP-9', s || ' rdf:type ' || c || '; ' || CASE WHEN c = 'Supplier' THEN 'Supplier SubClassOf Party' ELSE c || ' SubClassOf Customer; Customer SubClassOf Party' END FROM t
UNION ALL SELECT graph_id, s, 'locatedIn', o, 'EXP-31', s || ' inNation ' || o || '; inNation rdfs:subPropertyOf locatedIn' FROM r JOIN k USING (graph_id) WHERE p = 'inNation' AND k % 2 = 0
UNION ALL SELECT graph_id, o, 'placed', s, 'EXP-34', s || ' placedBy ' || o || '; placed owl:inverseOf placedBy' FROM r JOIN k USING (graph_id) WHERE p = 'placedBy' AND k % 2 = 1
UNION ALL SELECT graph_id, o, 'placedBy', s, 'EXP-34', s || ' placed ' || o || '; placedBy owl:inverseOf placed' FROM rel JOIN k USING (graph_id) WHERE p = 'placed' AND k % 2 = 1""")
def graphs_explained(spark, d):
    """EXP-1, 9, 28, 31, 34 over all graphs at once, each by its own schema."""
    g = nation_graphs(spark, d)
    m = R.materialize(g)
    f = X.Facts(g, g.types, g.relations, R.named_types(g, m.types).select("s", "c"), m.relations.select("s", "p", "o"))
    paths = X.explain_all(f, ["EXP-1", "EXP-9", "EXP-28", "EXP-31", "EXP-34"]).select("s", "p", "o", "strategy", F.array_join("justifications", "; ").alias("said"))
    return M.own_names(paths, "s")


# -- hierarchies -------------------------------------------------------------------------------------------------------


def part_classes(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): parts below their names, brands and sizes (by fours), names below their two words, words below their types, sizes below the next size."""
    (part,) = _read(spark, d, "part")
    words = part.select("p_name", F.explode(F.split("p_name", " ")).alias("w"), "p_type")
    part = part.withColumn("p_size", F.expr("p_size div 4"))
    sizes = part.select("p_size").distinct().select("p_size", F.lead("p_size").over(Window.orderBy("p_size")).alias("q")).where("q is not null")  # a row a size
    size = lambda c: F.concat(F.lit("size "), F.col(c).cast("string"))
    return _all([
        part.select(_name("part", "p_partkey").alias("a"), F.col("p_name").alias("b")), part.select(_name("part", "p_partkey").alias("a"), F.col("p_brand").alias("b")), part.select(_name("part", "p_partkey").alias("a"), size("p_size").alias("b")),
        words.select(F.col("p_name").alias("a"), F.col("w").alias("b")), words.select(F.col("w").alias("a"), F.col("p_type").alias("b")), sizes.select(size("p_size").alias("a"), size("q").alias("b")),
    ]).distinct()


_EDGES = """e(a, b) AS (SELECT 'part/' || p_partkey, p_name FROM part UNION SELECT 'part/' || p_partkey, p_brand FROM part UNION SELECT 'part/' || p_partkey, 'size ' || (p_size // 4) FROM part
UNION SELECT p_name, unnest(string_split(p_name, ' ')) FROM part UNION SELECT unnest(string_split(p_name, ' ')), p_type FROM part
UNION SELECT 'size ' || p_size, 'size ' || q FROM (SELECT p_size, lead(p_size) OVER (ORDER BY p_size) AS q FROM (SELECT DISTINCT p_size // 4 AS p_size FROM part)) WHERE q IS NOT NULL)"""


@query("closure_subclass", f"WITH RECURSIVE {_EDGES}, h(a, b) AS (SELECT a, b FROM e UNION SELECT h.a, e.b FROM h JOIN e ON h.b = e.a) SELECT a AS sub, b AS sup FROM h WHERE a <> b")
def closure_subclass(spark, d):
    """RSN-1, RSN-22: a class graph of the parts, deep (a chain of all sizes) and with diamonds (two words of a name)."""
    return C.closure(part_classes(spark, d)).where("a <> b").toDF("sub", "sup")


@query("closure_distances", f"WITH RECURSIVE {_EDGES}, h(a, b, n) AS (SELECT a, b, 1 FROM e UNION SELECT h.a, e.b, n + 1 FROM h JOIN e ON h.b = e.a), m AS (SELECT a, b, min(n) AS n FROM h WHERE a <> b GROUP BY a, b) SELECT m.a, m.b, CAST(m.n AS BIGINT) AS n, min(e.a) AS via FROM m JOIN e ON m.b = e.b LEFT JOIN m x ON x.a = m.a AND x.b = e.a WHERE (m.n = 1 AND e.a = m.a) OR x.n = m.n - 1 GROUP BY m.a, m.b, m.n")
def closure_distances(spark, d):
    """Shortest distances in the same graph, with the node before the end."""
    return C.distances(part_classes(spark, d))


_NO_SIZES = "WHERE a NOT LIKE 'size %' AND b NOT LIKE 'size %'"


@query("chains_shortest", f"WITH RECURSIVE {_EDGES}, h(a, b, nodes) AS (SELECT a, b, [a, b] FROM e {_NO_SIZES} UNION SELECT h.a, e.b, list_append(nodes, e.b) FROM h JOIN e ON h.b = e.a WHERE len(nodes) < 10 AND NOT list_contains(nodes, e.b)) SELECT a, b, array_to_string(min_by(nodes, (len(nodes), nodes)), ' > ') AS chain FROM h GROUP BY a, b")
def chains_shortest(spark, d):
    """EXP-9, EXP-10: the shortest chain of each pair, ties by the names on it."""
    edges = part_classes(spark, d).where("NOT a LIKE 'size %' AND NOT b LIKE 'size %'")
    return C.shortest_chains(edges.withColumn("kind", F.lit("SubClassOf")), 10).select("a", "b", F.array_join("nodes", " > ").alias("chain"))


@query("chains_all", f"WITH RECURSIVE {_EDGES}, h(a, b, nodes) AS (SELECT a, b, [a, b] FROM e {_NO_SIZES} UNION SELECT h.a, e.b, list_append(nodes, e.b) FROM h JOIN e ON h.b = e.a WHERE len(nodes) < 9 AND NOT list_contains(nodes, e.b)) SELECT a, b, array_to_string(nodes, ' > ') AS chain FROM h")
def chains_all(spark, d):
    """EXP-11, EXP-12: every chain over subclasses."""
    edges = part_classes(spark, d).where("NOT a LIKE 'size %' AND NOT b LIKE 'size %'")
    return C.all_chains(edges, 9).select("a", "b", F.array_join("nodes", " > ").alias("chain"))


_STEPS = """s(p, q, swap) AS (SELECT DISTINCT 'has ' || p_brand || ' ' || p_type, 'has ' || p_brand, false FROM part UNION SELECT DISTINCT 'has ' || p_brand, 'has', false FROM part UNION SELECT DISTINCT 'has ' || p_brand, p_brand || ' of', true FROM part UNION SELECT DISTINCT p_brand || ' of', 'has ' || p_brand, true FROM part UNION SELECT 'near', 'near', true)"""


@query("closure_subproperty", f"WITH RECURSIVE {_STEPS}, h(p, q, swap) AS (SELECT * FROM s UNION SELECT h.p, s.q, h.swap <> s.swap FROM h JOIN s ON h.q = s.p) SELECT * FROM h")
def closure_subproperty(spark, d):
    """RSN-3 .. RSN-6: properties of brands and types below each other, their inverses, and whether ends are swapped."""
    (part,) = _read(spark, d, "part")
    of = lambda a, b, swap: part.select(a.alias("a"), b.alias("b"), F.lit(swap).alias("swap"))
    brand, kind, back = F.concat(F.lit("has "), "p_brand"), F.concat(F.lit("has "), "p_brand", F.lit(" "), "p_type"), F.concat("p_brand", F.lit(" of"))
    steps = _all([of(kind, brand, False), of(brand, F.lit("has"), False), of(brand, back, True), of(back, brand, True), of(F.lit("near"), F.lit("near"), True)])
    return C.closure(steps.distinct(), swap=True).toDF("p", "q", "swap")


# -- descriptions ------------------------------------------------------------------------------------------------------


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Axioms that the tables say: nations and regions, names and types of parts, segments and what they trade."""
    part, supplier, customer, nation, region = _read(spark, d, "part", "supplier", "customer", "nation", "region")
    lit, c = F.lit, F.col
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).join(supplier.groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k")), "n_nationkey", "left")
    expr, kind = F.concat(lit("_:in "), c("n_nationkey").cast("string")), c("n_nationkey") % 3
    word = part.select("p_type", "p_brand", F.split("p_name", " ")[0].alias("first"), F.split("p_name", " ")[1].alias("last"), "p_name")
    make = F.concat(F.lower("p_type"), lit("Make"))
    typed = part.groupBy("p_type").agg(F.count("*").alias("k"), F.min("p_brand").alias("low"))
    trade = customer.select(F.concat(F.lower("c_mktsegment"), lit("Trade")).alias("p")).distinct()
    reach = lambda k: F.concat(lit("reach"), c("r_regionkey") + k)
    following = region.join(region.select((c("r_regionkey") - 1).alias("r_regionkey"), c("r_name").alias("next")), "r_regionkey")
    return _all([
        _axiom(places, "subclass", c("n_name"), c("r_name")), _axiom(word, "subclass", c("p_name"), c("first")), _axiom(word, "subclass", c("p_name"), c("last")),
        _axiom(places, "equivalent", c("n_name"), expr), _axiom(part, "equivalent", c("p_brand"), F.concat(lit("maker"), F.substring("p_brand", 7, 9))),
        _axiom(places.where(kind == 0), "some", lit("inRegion"), c("r_name"), expr), _axiom(places.where(kind == 1), "all", lit("inRegion"), c("r_name"), expr), _axiom(places.where(kind == 2), "exact", lit("hasSupplier"), lit("Supplier"), expr, n=F.coalesce("k", lit(0))),
        _axiom(following, "disjoint", c("r_name"), None, c("r_name"), lit(0), lit(2)), _axiom(following, "disjoint", c("next"), None, c("r_name"), lit(1), lit(2)),
        _axiom(word, "domain", make, c("last")), _axiom(typed, "range", F.concat(F.lower("p_type"), lit("Make")), c("low")),
        _axiom(typed.where("k % 2 = 0"), "functional", F.concat(F.lower("p_type"), lit("Make"))), _axiom(typed.where("k % 3 = 0"), "transitive", F.concat(F.lower("p_type"), lit("Make"))),
        _axiom(trade, "subproperty", c("p"), lit("tradeWith")), _axiom(trade, "inverse", c("p"), F.concat(c("p"), lit("Of"))),
        *[_axiom(region, "chain", F.concat(lit("step"), c("r_regionkey") + k), reach(0), c("r_regionkey"), lit(k), lit(2)) for k in (0, 1)],
        _axiom(region, "equivalent_property", reach(0), F.concat(lit("span"), c("r_regionkey"))), _axiom(following, "disjoint_property", reach(0), reach(1)),
    ]).distinct()


def _spaced(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_\\-\\s]+', ' ', 'g'))"


def _lab(x: str) -> str:
    return f"array_to_string(list_transform(string_split({_spaced(x)}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _words(x: str) -> str:
    return f"lower({_spaced(x)})"


_AND = "CASE WHEN len({0}) = 1 THEN {0}[1] ELSE array_to_string({0}[:-2], ', ') || ' and ' || {0}[-1] END"
_PLACES = "SELECT n_nationkey AS k, n_name, r_name, coalesce(m, 0) AS m FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS m FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey"
_CLASS_SQL = f"""WITH pl AS ({_PLACES}), sub(a, b) AS (SELECT n_name, r_name FROM pl UNION SELECT p_name, split_part(p_name, ' ', 1) FROM part UNION SELECT p_name, split_part(p_name, ' ', 2) FROM part),
same(a, b) AS (SELECT p_brand, 'maker' || substr(p_brand, 7) FROM part UNION SELECT 'maker' || substr(p_brand, 7), p_brand FROM part),
apart(a, b) AS (SELECT x.r_name, y.r_name FROM region x JOIN region y ON abs(x.r_regionkey - y.r_regionkey) = 1),
dom(p, c) AS (SELECT DISTINCT lower(p_type) || 'Make', split_part(p_name, ' ', 2) FROM part), low(c) AS (SELECT min(p_brand) FROM part GROUP BY p_type),
x(c, k, key, t) AS (SELECT a, 0, b, {_lab('a')} || ' is a type of ' || {_lab('b')} || '.' FROM sub UNION ALL SELECT a, 1, b, {_lab('a')} || ' is equivalent to ' || {_lab('b')} || '.' FROM same
UNION ALL SELECT n_name, 2, '', {_lab('n_name')} || ' is defined as a class that has ' || CASE k % 3 WHEN 0 THEN 'some ''in region'' relationship with an instance of ' || {_lab('r_name')} WHEN 1 THEN 'only ''in region'' relationship with an instance of ' || {_lab('r_name')} ELSE 'exactly ' || m || ' ''has supplier'' relationship(s) with an instance of Supplier' END || '.' FROM pl
UNION ALL SELECT a, 3, '', {_lab('a')} || ' is disjoint with ' || {_AND.format('l')} || '.' FROM (SELECT a, list_transform(list(b ORDER BY b), lambda v: {_lab('v')}) AS l FROM apart GROUP BY a)
UNION ALL SELECT c, 4, '', 'Instances of ' || {_lab('c')} || ' can have ' || {_AND.format('l')} || ' relationships.' FROM (SELECT c, list(DISTINCT {_words('p')} ORDER BY {_words('p')})[:3] AS l FROM dom GROUP BY c)),
names(c) AS (SELECT a FROM sub UNION SELECT b FROM sub UNION SELECT a FROM same UNION SELECT a FROM apart UNION SELECT c FROM dom UNION SELECT c FROM low)"""


@query("verbalize_class", _CLASS_SQL + f" SELECT n.c AS name, {_lab('n.c')} AS label, coalesce(string_agg(t, ' ' ORDER BY k, key, t), {_lab('n.c')} || ' is a class in this ontology.') AS description FROM names n LEFT JOIN x ON n.c = x.c GROUP BY n.c")
def verbalize_class(spark, d):
    """VRB-6, VRB-7 of the tables' vocabulary."""
    return V.describe_classes(vocabulary(spark, d)).drop("graph_id")


_PROPERTY_SQL = f"""WITH typed AS (SELECT lower(p_type) || 'Make' AS p, count(*) AS k, min(p_brand) AS low, min(split_part(p_name, ' ', 2)) AS dom FROM part GROUP BY p_type), trade(p) AS (SELECT DISTINCT lower(c_mktsegment) || 'Trade' FROM customer), g AS (SELECT r_regionkey AS k, EXISTS (SELECT 1 FROM region y WHERE y.r_regionkey = x.r_regionkey + 1) AS up FROM region x),
x(p, k, key, t) AS (SELECT p, 0, '', {_lab('p')} || ' is a kind of trade with.' FROM trade UNION ALL SELECT 'reach' || k, 1, '', 'Reach' || k || ' follows from step' || k || ' and then step' || (k + 1) || '.' FROM g
UNION ALL SELECT p, 2, '1', {_lab('p')} || ' is functional.' FROM typed WHERE k % 2 = 0 UNION ALL SELECT p, 2, '5', {_lab('p')} || ' is transitive.' FROM typed WHERE k % 3 = 0
UNION ALL SELECT p, 3, '', {_lab('p')} || ' is the inverse of ' || {_words("p || 'Of'")} || '.' FROM trade UNION ALL SELECT p || 'Of', 3, '', {_lab("p || 'Of'")} || ' is the inverse of ' || {_words('p')} || '.' FROM trade
UNION ALL SELECT 'reach' || k, 4, '', 'Reach' || k || ' is equivalent to span' || k || '.' FROM g UNION ALL SELECT 'span' || k, 4, '', 'Span' || k || ' is equivalent to reach' || k || '.' FROM g
UNION ALL SELECT 'reach' || k, 5, 'b', 'Reach' || k || ' is disjoint with reach' || (k + 1) || '.' FROM g WHERE up UNION ALL SELECT 'reach' || (k + 1), 5, 'a', 'Reach' || (k + 1) || ' is disjoint with reach' || k || '.' FROM g WHERE up
UNION ALL SELECT p, 6, '', {_lab('p')} || ' relates ' || {_lab('dom')} || ' to ' || {_lab('low')} || '.' FROM typed),
names(p) AS (SELECT p FROM x UNION SELECT 'tradeWith')"""


@query("verbalize_property", _PROPERTY_SQL + f" SELECT n.p AS name, {_lab('n.p')} AS label, coalesce(string_agg(t, ' ' ORDER BY k, key, t), {_lab('n.p')} || ' is a property in this ontology.') AS description FROM names n LEFT JOIN x ON n.p = x.p GROUP BY n.p")
def verbalize_property(spark, d):
    """VRB-9, VRB-10 of the tables' vocabulary."""
    return V.describe_properties(vocabulary(spark, d)).drop("graph_id")
