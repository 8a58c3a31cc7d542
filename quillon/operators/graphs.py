"""Many ontologies at once, each with its own schema (RSN-0 .. RSN-23, FLT-15, AGG-1, AGG-2 for folders of files).

A name is written as its graph, a separator and its IRI, so names of different graphs or namespaces never meet, and the
rules and strategies for one graph hold for all of them in the same joins.  The schemas are rows (``AXIOMS``), their
closures are made by joins; nothing of them is gathered but which kinds of axioms there are.  ``own_names`` turns results back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.closure import all_chains, closure, list_ranks, shortest_chains
from quillon.operators.model import THING, Graph, Schema
from quillon.operators.schema_tables import CHARACTERISTICS, DEEP_NODES, SEARCH_NODES, TRACE_NODES
from quillon.plans.lineage import settle
from quillon.sources.rdf import _CHARACTERS, OWL, RDF, RDFS, RESTRICTIONS, is_schema

SEPARATOR = "\x1f"
#: One row an axiom, or one for each part (at: its place, of n) of an axiom or expression ``id``.
AXIOMS = "graph_id string, kind string, id string, a string, b string, at int, n int"
#: A table of the schemas is broadcast up to so many rows, else joined by a shuffle.
BROADCAST_ROWS = 1 << 16
_ANONYMOUS = SEPARATOR + "_:"


def name(graph: Column, iri: Column) -> Column:
    """A name within its graph; Thing is the same in all of them."""
    return F.when((iri == OWL + "Thing") | (iri == THING), F.lit(THING)).otherwise(F.concat(graph, F.lit(SEPARATOR), iri))


def graph_of_name(qualified: Column) -> Column:
    """The graph of a name, or of a made-up witness of one."""
    return F.substring_index(F.when(qualified.startswith("_:"), F.substring(qualified, 3, 1 << 30)).otherwise(qualified), SEPARATOR, 1)


def own_names(rows: DataFrame, by: str) -> DataFrame:
    """graph_id (of the column ``by``) and the columns, graphs taken out of all names in texts, arrays and structs."""
    mark = F.concat(F.col("graph_id"), F.lit(SEPARATOR))

    def plain(c: Column, kind) -> Column:
        if kind.typeName() == "string":
            return F.replace(c, mark, F.lit(""))
        if kind.typeName() == "array":
            return F.transform(c, lambda x: plain(x, kind.elementType))
        if kind.typeName() == "struct":
            return F.struct(*[plain(c[f.name], f.dataType).alias(f.name) for f in kind])
        return c

    marked = rows.withColumn("graph_id", graph_of_name(F.col(by)))
    return marked.select("graph_id", *[plain(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema if f.name != "graph_id"])


_T = Callable[["Graphs"], DataFrame]


def _pairs(*kinds: str) -> _T:
    return lambda g: reduce(DataFrame.unionByName, [g.kind(k).select("a", "b") for k in kinds]).distinct()


def _both(kind: str) -> _T:
    return lambda g: g.kind(kind).select("a", "b").unionByName(g.kind(kind).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _class_edges(g: Graphs) -> DataFrame:
    return g.kind("subclass").select("a", "b").unionByName(_both("equivalent")(g)).distinct()


def _named(rows: DataFrame, *columns: str) -> DataFrame:
    return reduce(lambda r, c: r.where(~F.contains(F.col(c), F.lit(_ANONYMOUS))), columns, rows)


def _kinded_edges(g: Graphs) -> DataFrame:
    """Named (a, b, kind) over sub- and equivalent classes; an equivalence wins over a subclass axiom (it is smaller)."""
    sub = g.kind("subclass").select("a", "b", F.lit("SubClassOf").alias("kind"))
    return _named(sub.unionByName(_both("equivalent")(g).withColumn("kind", F.lit("EquivalentClasses"))), "a", "b")


def _steps(g: Graphs) -> DataFrame:
    straight = g.kind("subproperty").select("a", "b").unionByName(_both("equivalent_property")(g)).withColumn("swap", F.lit(False))
    turned = _both("inverse")(g).unionByName(g.kind("symmetric").select("a", F.col("a").alias("b"))).withColumn("swap", F.lit(True))
    return closure(straight.unionByName(turned), swap=True).select(F.col("a").alias("p"), F.col("b").alias("q"), "swap")


def _searches(g: Graphs) -> DataFrame:
    found = shortest_chains(_kinded_edges(g), TRACE_NODES)
    at = F.sequence(F.lit(0), F.size("kinds") - 1)
    word = lambda i: F.when(F.get("kinds", i) == "SubClassOf", F.lit(" SubClassOf ")).otherwise(F.lit(" EquivalentTo "))
    words = F.transform(at, lambda i: F.concat(F.get("nodes", i), word(i), F.get("nodes", i + 1)))
    steps = F.transform(at, lambda i: F.struct(F.get("kinds", i).alias("kind"), F.array(F.get("nodes", i), F.get("nodes", i + 1)).alias("args")))
    return found.select(F.col("a").alias("c"), F.col("b").alias("d"), words.alias("words"), steps.alias("steps"))


def _holders(g: Graphs, subclass: bool) -> DataFrame:
    """(d, x): named classes that equal an expression, or (if asked) lie below it."""
    pairs = _class_edges(g) if subclass else _both("equivalent")(g)
    return _named(pairs, "a").where(F.contains(F.col("b"), F.lit(_ANONYMOUS))).select(F.col("a").alias("d"), F.col("b").alias("x")).distinct()


def _operands(g: Graphs, kind: str, subclass: bool) -> DataFrame:
    """(d, x, c, n, k): named operands of an expression with n operands, k of them named."""
    ops = _named(g.kind(kind).select(F.col("id").alias("x"), F.col("a").alias("c"), "n"), "c")
    sizes = ops.groupBy("x").agg(F.count("*").cast("int").alias("k"))
    return _holders(g, subclass).join(ops.join(sizes, "x"), "x").select("d", "x", "c", "n", "k")


def _restriction(kind: str) -> _T:
    return lambda g: g.kind(kind).select(F.col("id").alias("x"), F.col("a").alias("p"), F.col("b").alias("f"))


def _mixed(g: Graphs) -> tuple[DataFrame, DataFrame]:
    ops = _holders(g, False).join(g.kind("and").select(F.col("id").alias("x"), F.col("at").alias("k"), F.col("a").alias("c")), "x")
    named = _named(ops, "c").select("d", "x", "k", "c")
    some = ops.join(g.table("some").withColumnRenamed("x", "c"), "c").select("d", "x", "k", "p", "f")
    return named.join(some.select("d", "x").distinct(), ["d", "x"], "left_semi"), some.join(named.select("d", "x").distinct(), ["d", "x"], "left_semi")


def _renamed(make: _T, *columns: str) -> _T:
    return lambda g: make(g).toDF(*columns)


def _chains(make: Callable, edges: _T, most: int, *columns: str) -> _T:
    return lambda g: make(edges(g), most).select(F.col("a").alias("c"), F.col("b").alias("d"), *columns)


_SUB = lambda g: _named(g.kind("subclass").select("a", "b"), "a", "b")
#: The tables of ``schema_tables`` for many graphs: the kinds of axioms that they rest on, and how they are made.
TABLES: dict[str, tuple[tuple[str, ...], _T]] = {
    "steps": (("subproperty", "equivalent_property", "inverse", "symmetric"), _steps),
    "subproperty": (("subproperty",), _renamed(_pairs("subproperty"), "q", "p")),
    "subproperty_closed": (("subproperty",), lambda g: closure(g.kind("subproperty")).where("a <> b").toDF("p", "q")),
    "inverse": (("inverse",), _renamed(_both("inverse"), "p", "q")),
    "chains": (("chain",), lambda g: g.kind("chain").select("id", F.col("a").alias("link"), F.col("b").alias("target"), "at", "n")),
    "two_links": (("chain",), lambda g: g.kind("chain").where("n = 2 and at = 0").select("id", F.col("a").alias("p1"), F.col("b").alias("t")).join(g.kind("chain").where("n = 2 and at = 1").select("id", F.col("a").alias("p2")), "id").select("p1", "p2", "t").distinct()),
    "class_closed": (("subclass", "equivalent"), lambda g: closure(_class_edges(g)).where("a <> b").toDF("c", "d")),
    "subclass_named": (("subclass",), lambda g: _SUB(g).distinct().toDF("c", "d")),
    "equivalent_named": (("equivalent",), lambda g: _named(_both("equivalent")(g), "a", "b").toDF("c", "d")),
    "traces": (("subclass",), lambda g: shortest_chains(_SUB(g).withColumn("kind", F.lit("")), TRACE_NODES).select(F.col("a").alias("c"), F.col("b").alias("d"), "nodes")),
    "searches": (("subclass", "equivalent"), _searches),
    "all_paths": (("subclass", "equivalent"), _chains(all_chains, lambda g: _named(_class_edges(g), "a", "b"), SEARCH_NODES, "nodes")),
    "deep_paths": (("subclass",), _chains(all_chains, _SUB, DEEP_NODES, "nodes")),
    "domain": (("domain",), _renamed(_pairs("domain"), "p", "c")),
    "range": (("range",), _renamed(_pairs("range"), "p", "c")),
    "or": (("or",), lambda g: g.kind("or").select(F.col("id").alias("x"), F.col("a").alias("c")).distinct()),
    "and": (("and",), lambda g: g.kind("and").select(F.col("id").alias("x"), F.col("a").alias("c")).distinct().join(g.kind("and").groupBy(F.col("id").alias("x")).agg(F.countDistinct("a").cast("int").alias("n")), "x").select("x", "c", "n")),
    "some": (("some",), _restriction("some")),
    "all": (("all",), _restriction("all")),
    "self": (("self",), lambda g: _restriction("self")(g).select("x", "p")),
    "value": (("value",), _renamed(_restriction("value"), "x", "p", "o")),
    "max_one": (("max", "exact"), lambda g: g.kind("max").unionByName(g.kind("exact")).where("n = 1").select(F.col("id").alias("x"), F.col("a").alias("p"), F.coalesce("b", F.lit(THING)).alias("f"))),
    "witnessed": (("some",), lambda g: _named(g.table("class_closed"), "c").join(g.table("some").withColumnRenamed("x", "d"), "d").select("c", F.col("d").alias("x"), "p", "f")),
    "keys": (("key",), lambda g: g.kind("key").select("id", F.col("a").alias("c"), F.col("b").alias("p"), "at", "n")),
    "disjoint": (("disjoint", "not"), lambda g: g.kind("disjoint").select(F.col("id").alias("axiom"), F.col("a").alias("c"), "at").unionByName(
        g.kind("not").select(F.concat(F.lit("not "), "id").alias("axiom"), F.explode(F.array(F.struct(F.col("id").alias("c"), F.lit(0).alias("at")), F.struct(F.col("a").alias("c"), F.lit(1).alias("at")))).alias("m")).select("axiom", "m.*"))),
    "disjoint_property": (("disjoint_property",), _renamed(_pairs("disjoint_property"), "p", "q")),
    "different": (("different",), lambda g: g.kind("different").select(F.col("id").alias("axiom"), F.col("a").alias("s"))),
    "and_below": (("and",), lambda g: _operands(g, "and", True).where("n >= 2")),
    "and_equal": (("and",), lambda g: _operands(g, "and", False).where("k >= 2").select("d", "x", "c", "k")),
    "or_equal": (("or",), lambda g: _operands(g, "or", False).select("d", "x", "c")),
    "some_of": (("some",), lambda g: _holders(g, True).join(g.table("some"), "x").select("d", "x", "p", "f")),
    "all_of": (("all",), lambda g: _holders(g, True).join(g.table("all"), "x").select("d", "x", "p", "f")),
    "mixed_named": (("and",), lambda g: _mixed(g)[0]),
    "mixed_some": (("and",), lambda g: _mixed(g)[1]),
}


@dataclass
class Graphs(Graph):
    """Facts of many graphs, their schemas as rows ``axioms``; all names are written by ``name``."""

    axioms: DataFrame | None = None
    made: dict = field(default_factory=dict)

    def kind(self, k: str) -> DataFrame:
        return self.axioms.where(F.col("kind") == k)

    def kinds(self) -> set[str]:
        if "kinds" not in self.made:
            self.made["kinds"] = {r[0] for r in self.axioms.select("kind").distinct().collect()}
        return self.made["kinds"]

    def _kept(self, key: str, rows: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.made:
            out = settle(rows())
            self.made[key] = F.broadcast(out) if out.count() <= BROADCAST_ROWS else out
        return self.made[key]

    def table(self, name: str) -> DataFrame:
        """A table of the schemas by its name, made once."""
        return self._kept(name, lambda: TABLES[name][1](self).distinct())

    def has(self, *names: str) -> bool:
        return any(self.kinds() & ({n} if n in CHARACTERISTICS else set(TABLES[n][0])) for n in names)

    def having(self, relations: DataFrame, kind: str) -> DataFrame:
        return relations.join(self._kept(f"is {kind}", lambda: self.kind(kind).select(F.col("a").alias("p")).distinct()), "p", "left_semi").select(*relations.columns)

    def reflexives(self, individuals: DataFrame) -> DataFrame:
        of = self._kept("reflexive of", lambda: self.kind("reflexive").select(F.col("a").alias("p"), graph_of_name(F.col("a")).alias("_g")).distinct())
        return individuals.withColumn("_g", graph_of_name(F.col("s"))).join(of, "_g").select("s", "p")

    def anonymous(self, c: Column) -> Column:
        return F.contains(c, F.lit(_ANONYMOUS))

    def moving(self, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
        active = self._kept("active", lambda: self.table("steps").select("p").unionByName(self.kind("chain").select(F.col("a").alias("p"))).unionByName(self.kind("transitive").select(F.col("a").alias("p"))).distinct())
        return tuple(relations.join(active, "p", how).select(*relations.columns) for how in ("left_semi", "left_anti"))

    def derived_properties(self) -> DataFrame:
        """(p): properties of facts that chains, transitive axioms and the steps after these derive."""
        made = lambda: self.table("chains").select(F.col("target").alias("p")).unionByName(self.kind("transitive").select(F.col("a").alias("p"))).distinct()
        return self._kept("derived properties", lambda: made().unionByName(made().join(self.table("steps"), "p").select(F.col("q").alias("p"))).distinct())

    def derived_classes(self) -> DataFrame:
        """(c): classes that class expressions derive, and all above them."""
        of = {"or": "x", "and": "x", "some": "x", "all": "f", "self": "x", "value": "x"}
        rows = [self.table(t).select(F.col(k).alias("c")) for t, k in of.items()] + [self.table("and").select("c")]
        made = reduce(DataFrame.unionByName, rows)
        return self._kept("derived classes", lambda: made.unionByName(made.join(self.table("class_closed"), "c").select(F.col("d").alias("c"))).distinct())

    def used(self, relations: DataFrame) -> DataFrame:
        props = self._kept("used", lambda: self.axioms.where(F.col("kind").isin("some", "all", "self", "value", "min", "max", "exact")).select(F.col("a").alias("p")).distinct())
        return relations.join(props, "p", "left_semi").select(*relations.columns)


def many(types: DataFrame, relations: DataFrame, axioms: DataFrame, same: DataFrame | None = None, different: DataFrame | None = None) -> Graphs:
    """Graphs of tables with a column graph_id and plain names: types (s, c), relations (s, p, o), AXIOMS, same (a, b) and
    different (axiom, s).  Names of expressions begin with ``_:``."""
    g = F.col("graph_id")
    of = lambda rows, *columns: rows.select(*[name(g, F.col(c)).alias(c) for c in columns])
    ax = settle(axioms.select("graph_id", "kind", *[name(g, F.col(c)).alias(c) for c in ("id", "a", "b")], "at", "n").distinct())
    return Graphs(of(types, "s", "c"), of(relations, "s", "p", "o"), Schema(), None if same is None else of(same, "a", "b"), None if different is None else of(different, "axiom", "s"), ax)


def axiom_rows(s: Schema, graph: str) -> list[tuple]:
    """The rows of AXIOMS of a schema that the driver holds."""
    known = lambda x: f"_:{x}" if x in s.expressions else x
    out = [(graph, kind, None, known(a), known(b), None, None) for kind in ("subclass", "equivalent", "subproperty", "equivalent_property", "disjoint_property", "inverse", "domain", "range") for a, b in getattr(s, kind)]
    out += [(graph, kind, None, p, None, None, None) for kind in CHARACTERISTICS for p in getattr(s, kind)]
    groups = [(f"{a}|{b}", (a, b)) for a, b in s.disjoint] + list(s.disjoint_groups)
    out += [(graph, "disjoint", x, known(c), None, k, len(cs)) for x, cs in groups for k, c in enumerate(cs)]
    out += [(graph, "different", x, i, None, None, None) for x, i in s.all_different]
    out += [(graph, "chain", f"chain {n}", p, t, k, len(links)) for n, (links, t) in enumerate(s.chains) for k, p in enumerate(links)]
    out += [(graph, "key", f"key {n}", known(c), p, k, len(ps)) for n, (c, ps) in enumerate(s.keys) for k, p in enumerate(ps)]
    for x, e in s.expressions.items():
        if e.kind in ("and", "or", "not"):
            out += [(graph, e.kind, known(x), known(o), None, k, len(e.operands)) for k, o in enumerate(e.operands)]
        else:
            out.append((graph, e.kind, known(x), e.prop, None if e.filler is None else known(e.filler), None, e.n))
    return out


def axioms_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, AXIOMS)


# -- from files --------------------------------------------------------------------------------------------------------

_PAIRS = {RDFS + "subClassOf": "subclass", OWL + "equivalentClass": "equivalent", RDFS + "subPropertyOf": "subproperty", OWL + "equivalentProperty": "equivalent_property", OWL + "propertyDisjointWith": "disjoint_property", OWL + "inverseOf": "inverse", RDFS + "domain": "domain", RDFS + "range": "range"}


def _label(v: str, kind: str) -> Column:
    """A term's plain name: its IRI, or a blank node's marked as such."""
    return F.when(F.col(kind) == "bnode", F.concat(F.lit("_:"), F.col(v))).otherwise(F.col(v))


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def axioms_of(triples: DataFrame) -> DataFrame:
    """AXIOMS of the triples of many files: lists are ranked by doubling pointers, expressions gathered by their nodes.

    Data values are no axioms; unknown predicates are facts (see ``graphs_of``).  What cannot be read (an error row, a
    list that bites its tail, a restriction without a property) gives no axiom.
    """
    t = settle(triples.where(F.col("_error").isNull() & is_schema(F.col("p"))).select("graph_id", _label("s", "s_kind").alias("s"), "p", _label("o", "o_kind").alias("o"), F.col("o_kind").alias("kind")).distinct())
    g, none, no = F.col("graph_id"), F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df: DataFrame, kind: Column, id_: Column = none, a: Column = none, b: Column = none, at: Column = no, n: Column = no) -> DataFrame:
        return df.select(g, kind.alias("kind"), id_.alias("id"), a.alias("a"), b.alias("b"), at.cast("int").alias("at"), n.cast("int").alias("n"))

    s, o = F.col("s"), F.col("o")
    nodes = t.where("kind <> 'literal'")
    pairs = nodes.withColumn("k", _looked_up(F.col("p"), _PAIRS)).where("k is not null")
    apart = nodes.where(F.col("p") == OWL + "disjointWith").select(g, F.concat_ws("|", "s", "o").alias("id"), F.posexplode(F.array("s", "o")).alias("at", "c"))
    kinds = {OWL + k: v for k, v in _CHARACTERS.items()}
    typed = nodes.where(F.col("p") == RDF + "type")
    # Lists: cell, item and place by the list's head.
    cell = F.concat(g, F.lit(SEPARATOR), s)
    cells = nodes.where(F.col("p") == RDF + "rest").select(cell.alias("cell"), F.concat(g, F.lit(SEPARATOR), o).alias("next"))
    ranks = list_ranks(cells)
    items = t.where(F.col("p") == RDF + "first").select(g, cell.alias("cell"), o.alias("item")).join(ranks, "cell")
    heads = nodes.where(F.col("p").isin(*[OWL + k for k in ("intersectionOf", "unionOf", "disjointUnionOf", "members", "distinctMembers", "propertyChainAxiom", "hasKey")]))
    heads = heads.select("s", "p", F.col("o").alias("head"), F.concat(g, F.lit(SEPARATOR), o).alias("cell")).join(ranks, "cell").select("s", "p", "head", "last", F.col("left").alias("n"))
    listed = settle(heads.join(items.select(g, "item", "last", "left"), "last").where("left <= n").select(g, "s", "p", "head", "item", (F.col("n") - F.col("left")).cast("int").alias("at"), F.col("n").cast("int").alias("n")))
    of = lambda *k: listed.where(F.col("p").isin(*[OWL + x for x in k]))
    at, n, item = F.col("at"), F.col("n"), F.col("item")
    constructor = F.when(F.col("p") == OWL + "intersectionOf", "and").otherwise("or")
    mine = F.when(s.startswith("_:"), s).otherwise(F.concat(F.lit("_:"), constructor, F.lit(" of "), s))
    boolean = of("intersectionOf", "unionOf", "disjointUnionOf")
    members = of("members", "distinctMembers").join(typed.select(g, "s", F.col("o").alias("k")), ["graph_id", "s"])
    first = lambda *k: F.coalesce(*[F.max(F.when(F.col("p") == OWL + x, o)) for x in k])
    counts = [k for k in RESTRICTIONS if k.lower().endswith("cardinality")]
    restrictions = t.where(F.col("p").isin(*[OWL + k for k in (*RESTRICTIONS, "onProperty", "onClass")])).groupBy("graph_id", "s").agg(
        first("onProperty").alias("prop"), first("someValuesFrom", "allValuesFrom", "onClass", "hasValue").alias("filler"), first(*counts).alias("count"),
        F.coalesce(*[F.max(F.when(F.col("p") == OWL + k, F.lit(v))) for k, v in RESTRICTIONS.items()]).alias("k"),
    ).where("prop is not null and k is not null")
    out = [
        rows(pairs, F.col("k"), a=s, b=o), rows(apart, F.lit("disjoint"), F.col("id"), F.col("c"), at=at, n=F.lit(2)),
        rows(typed.withColumn("k", _looked_up(o, kinds)).where("k is not null"), F.col("k"), a=s),
        rows(nodes.where(F.col("p") == OWL + "complementOf"), F.lit("not"), s, o, at=F.lit(0), n=F.lit(1)),
        rows(boolean, constructor, mine, item, at=at, n=n), rows(boolean.where(~s.startswith("_:")), F.lit("equivalent"), a=s, b=mine),
        rows(of("disjointUnionOf"), F.lit("disjoint"), F.concat(F.lit("union "), s), item, at=at, n=n),
        rows(members.where(F.col("k") == OWL + "AllDifferent"), F.lit("different"), s, item), rows(members.where(F.col("k") == OWL + "AllDisjointClasses"), F.lit("disjoint"), s, item, at=at, n=n),
        rows(of("propertyChainAxiom"), F.lit("chain"), F.concat_ws("|", "head", "s"), item, s, at, n), rows(of("hasKey"), F.lit("key"), F.concat_ws("|", "head", "s"), s, item, at, n),
        rows(restrictions, F.col("k"), s, F.col("prop"), F.col("filler"), n=F.expr("try_cast(count AS int)")),
    ]
    return reduce(DataFrame.unionByName, out).distinct()


def graphs_of(triples: DataFrame) -> Graphs:
    """The graphs of the triples of many files, each with its own schema; names are whole IRIs.

    Facts are types by classes that are not OWL's own (expressions included) and statements between resources by properties of no
    standard vocabulary; annotations and data values are no facts here.
    """
    ok = triples.where("_error is null")
    builtin = F.col("o").startswith(OWL) | F.col("o").startswith(RDFS) | F.col("o").startswith(RDF)
    thing = F.col("o") == OWL + "Thing"
    iri = F.col("s_kind") == "iri"
    typed = ok.where((F.col("p") == RDF + "type") & iri & (F.col("o_kind") != "literal") & (~builtin | thing)).select("graph_id", "s", _label("o", "o_kind").alias("c")).distinct()
    between = ok.where(iri & (F.col("o_kind") == "iri"))
    relations = between.where(~is_schema(F.col("p"))).select("graph_id", "s", "p", "o").distinct()
    same = between.where(F.col("p") == OWL + "sameAs").select("graph_id", F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    apart = between.where(F.col("p") == OWL + "differentFrom").select("graph_id", F.concat_ws("|", "s", "o").alias("axiom"), F.explode(F.array("s", "o")).alias("s")).distinct()
    return many(typed, relations, axioms_of(triples), same, apart)


# -- results by graph --------------------------------------------------------------------------------------------------


def clashing(found: DataFrame) -> DataFrame:
    """(graph_id, rule, a, b) of clashes found in ``Graphs``."""
    return own_names(found, "a")


def without(g: Graphs, gone: DataFrame) -> Graphs:
    """FLT-15: the graphs but those whose graph_id is in ``gone``; their schemas leave with them."""
    gone = gone.select(F.col("graph_id").alias("_g")).distinct()
    left = lambda rows, by: None if rows is None else rows.join(gone, graph_of_name(F.col(by)) == F.col("_g"), "left_anti")
    return Graphs(left(g.types, "s"), left(g.relations, "s"), Schema(), left(g.same, "a"), left(g.different, "s"), g.axioms.join(gone, F.col("graph_id") == F.col("_g"), "left_anti"))


def graph_sizes(g: Graphs) -> DataFrame:
    """AGG-1 by graph: (graph_id, kind, n) for axioms without and with individuals (tbox, abox), individuals, named
    classes and properties; kinds that a graph has none of are 0."""
    who = lambda c: graph_of_name(F.col(c)).alias("graph_id")
    t, r, x = g.types.select(who("s"), "s", "c"), g.relations.select(who("s"), "s", "p", "o"), g.axioms
    individual_axioms = x.where("kind = 'different'").select("graph_id", F.lit("abox").alias("kind"), F.col("id").alias("v"))
    parts = ("and", "or", "not", "some", "all", "self", "value", "min", "max", "exact", "different")
    whole = F.coalesce("id", F.concat_ws("|", "kind", "a", "b"))
    named = lambda rows: rows.where(~F.contains(F.col("v"), F.lit(_ANONYMOUS)) & (F.col("v") != THING))
    as_ = lambda rows, kind, v: rows.select("graph_id", F.lit(kind).alias("kind"), v.alias("v"))
    c = F.col
    classes = [x.where(c("kind").isin("subclass", "equivalent")).select("graph_id", F.explode(F.array("a", "b")).alias("v")), x.where(c("kind").isin("disjoint", "and", "or", "not", "key")).select("graph_id", c("a").alias("v")), x.where(c("kind").isin("domain", "range", "some", "all", "min", "max", "exact")).where("b is not null").select("graph_id", c("b").alias("v")), t.select("graph_id", c("c").alias("v"))]
    props = [x.where(c("kind").isin("subproperty", "equivalent_property", "disjoint_property", "inverse", "chain")).select("graph_id", F.explode(F.array("a", "b")).alias("v")), x.where(c("kind").isin("domain", "range", *CHARACTERISTICS, "some", "all", "self", "value", "min", "max", "exact")).select("graph_id", c("a").alias("v")), x.where("kind = 'key'").select("graph_id", c("b").alias("v")), r.select("graph_id", c("p").alias("v"))]
    rows = [
        as_(x.where(~c("kind").isin(*parts)), "tbox", F.concat_ws("|", "kind", whole)), individual_axioms,
        as_(t, "abox", F.concat_ws("|", "s", "c")), as_(r, "abox", F.concat_ws("|", "s", "p", "o")),
        *([] if g.same is None else [g.same.select(who("a"), F.lit("abox").alias("kind"), F.concat_ws("=", "a", "b").alias("v"))]), *([] if g.different is None else [g.different.select(who("s"), F.lit("abox").alias("kind"), c("axiom").alias("v"))]),
        as_(t, "individuals", c("s")), as_(r, "individuals", c("s")), as_(r, "individuals", c("o")),
        *[named(as_(d, "classes", c("v"))) for d in classes], *[as_(d, "properties", c("v")) for d in props],
    ]
    counted = reduce(DataFrame.unionByName, rows).distinct().groupBy("graph_id").pivot("kind", ["tbox", "abox", "individuals", "classes", "properties"]).agg(F.count("v"))
    return counted.unpivot("graph_id", ["tbox", "abox", "individuals", "classes", "properties"], "kind", "n").select("graph_id", "kind", F.coalesce("n", F.lit(0)).alias("n"))
