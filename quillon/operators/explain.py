"""Explanation strategies (EXP-1 .. EXP-35): one function each, set at a time.

A strategy joins what holds (``typ``, ``rel``: entailed; ``a_typ``, ``a_rel``: asserted) with the schema and yields path rows
(s, p, o, strategy, type, complexity, axioms, justifications).  Where one witness is enough the smallest is taken.
Facts and schema tables have no row twice, so no path comes twice and the long texts need no comparison.
Class targets have p = ``rdf:type``.  Only entailed targets are explained: ``path`` makes the semi-join with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P
from pyspark.sql.window import Window

from quillon.operators.model import Graph
from quillon.plans.lineage import release, settle, settle_all

TYPE = "rdf:type"
# Fixed values throughout this module: strategy names, kinds of paths and axioms, and the wordings of justifications, which
# results must share to be compared.


@dataclass
class Facts:
    """A graph's asserted and entailed facts, as the strategies read them; no entailed fact twice."""

    g: Graph
    a_typ: DataFrame
    a_rel: DataFrame
    typ: DataFrame
    rel: DataFrame
    #: Whether each strategy leaves out targets that are not entailed, before it writes its texts; else its reader does.
    checked: bool = True
    #: What a strategy makes of its paths; rows with their texts (``told``) if nothing else is set.
    form: Callable[[Untold], DataFrame] | None = None


@dataclass
class Untold:
    """Paths of a strategy before their texts are made: the short rows, and the columns that tell them."""

    rows: DataFrame
    strategy: str
    kind: str
    s: Column
    p: Column
    o: Column
    complexity: int | None
    axioms: Column
    said: Column
    #: The rows hold lists other than of the schema, so names of individuals are also found within the texts.
    lists: bool = False


def told(u: Untold) -> DataFrame:
    n = F.size(u.axioms) if u.complexity is None else F.lit(u.complexity)
    return u.rows.select(u.s.alias("s"), u.p.alias("p"), u.o.alias("o"), F.lit(u.strategy).alias("strategy"), F.lit(u.kind).alias("type"), n.cast("int").alias("complexity"), u.axioms.alias("axioms"), u.said.alias("justifications"))


def lit_text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def axiom(kind: str, *args: Column | str) -> Column:
    """A struct of an axiom's kind and arguments."""
    return F.struct(F.lit(kind).alias("kind"), F.array(*[F.lit(a) if isinstance(a, str) else a for a in args]).alias("args"))


def path(f: Facts, rows: DataFrame, strategy: str, kind: str, s: Column, p: Column, o: Column, axioms: list[Column] | Column, said: list[Column] | Column, complexity: int | None = None, chains: DataFrame | None = None) -> DataFrame:
    """The paths of rows with entailed targets.  What is joined and sorted are the short rows; texts are made of those that stay.

    chains: a schema table of (c, d) whose further columns only the texts need.
    """
    if f.checked:
        rows = rows.join(f.typ.select(F.col("s").alias("_s"), F.col("c").alias("_o")), (s == F.col("_s")) & (o == F.col("_o")), "left_semi") if strategy in CLASS_STRATEGIES else rows.join(f.rel.select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o")), (s == F.col("_s")) & (p == F.col("_p")) & (o == F.col("_o")), "left_semi")
    lists = any(isinstance(x.dataType, (P.ArrayType, P.StructType)) for x in rows.schema)
    rows = rows if chains is None else rows.join(chains, ["c", "d"])
    ax = F.array(*axioms) if isinstance(axioms, list) else axioms
    just = F.array(*said) if isinstance(said, list) else said
    return (f.form or told)(Untold(rows, strategy, kind, s, p, o, complexity, ax, just, lists))


def _entailed_types(f: Facts, paths: DataFrame) -> DataFrame:
    return paths.join(f.typ.select("s", F.col("c").alias("o")), ["s", "o"], "left_semi")


def _entailed_relations(f: Facts, paths: DataFrame) -> DataFrame:
    return paths.join(f.rel, ["s", "p", "o"], "left_semi")


c = F.col


def _type_of(s: Column, o: Column) -> Column:
    return lit_text(s, " rdf:type ", o)


def _edge(s: Column, p: Column, o: Column) -> Column:
    return lit_text(s, " ", p, " ", o)


# -- classes from the hierarchy ----------------------------------------------------------------------------------------


def subclass_visit(f: Facts) -> DataFrame:
    """EXP-1"""
    r = f.typ.join(f.g.table("subclass_named"), "c")
    return path(f, r, "EXP-1", "SUBSUMPTION", c("s"), F.lit(TYPE), c("d"), [axiom("ClassAssertion", c("c"), c("s")), axiom("SubClassOf", c("c"), c("d"))], [_type_of(c("s"), c("c")), lit_text(c("c"), " SubClassOf ", c("d"))])


def _equivalent(f: Facts, strategy: str, word: str) -> DataFrame:
    r = f.typ.join(f.g.table("equivalent_named"), "c")
    both = [F.least("c", "d"), F.greatest("c", "d")]
    return path(f, r, strategy, "EQUIVALENT_CLASS", c("s"), F.lit(TYPE), c("d"), [axiom("ClassAssertion", c("c"), c("s")), axiom("EquivalentClasses", *both)], [_type_of(c("s"), c("c")), lit_text(c("c"), f" {word} ", c("d"))])


def equivalent_visit(f: Facts) -> DataFrame:
    """EXP-2"""
    return _equivalent(f, "EXP-2", "EquivalentTo")


def equivalent_class(f: Facts) -> DataFrame:
    """EXP-17"""
    return _equivalent(f, "EXP-17", "owl:equivalentClass")


def direct_type(f: Facts) -> DataFrame:
    """EXP-28"""
    return path(f, f.a_typ, "EXP-28", "DIRECT_ASSERTION", c("s"), F.lit(TYPE), c("c"), [axiom("ClassAssertion", c("c"), c("s"))], [lit_text(_type_of(c("s"), c("c")), " (direct assertion)")], 1)


def _steps(nodes: Column, word: str, same: DataFrame | None = None) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(nodes) - 2), lambda i: F.concat(F.get(nodes, i), F.lit(f" {word} "), F.get(nodes, i + 1)))


def _step_axioms(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(nodes) - 2), lambda i: F.struct(F.lit("SubClassOf").alias("kind"), F.array(F.get(nodes, i), F.get(nodes, i + 1)).alias("args")))


def subclass_trace(f: Facts) -> DataFrame:
    """EXP-9: from each asserted type the shortest subclass chain, ties by the names on it."""
    chains = f.g.table("traces")
    r = f.a_typ.join(chains.select("c", "d"), "c")
    return path(f, r, "EXP-9", "SUBSUMPTION", c("s"), F.lit(TYPE), c("d"), F.concat(F.array(axiom("ClassAssertion", c("c"), c("s"))), _step_axioms(c("nodes"))), F.concat(F.array(_type_of(c("s"), c("c"))), _steps(c("nodes"), "SubClassOf")), chains=chains)


def hierarchy_search(f: Facts) -> DataFrame:
    """EXP-10: from each asserted or entailed type the shortest chain over sub- and equivalent classes."""
    chains = f.g.table("searches")
    r = f.typ.join(chains.select("c", "d"), "c")
    return path(f, r, "EXP-10", "SUBSUMPTION", c("s"), F.lit(TYPE), c("d"), F.concat(F.array(axiom("ClassAssertion", c("c"), c("s"))), c("steps")), F.concat(F.array(_type_of(c("s"), c("c"))), c("words")), chains=chains)


def subclass_paths(f: Facts) -> DataFrame:
    """EXP-11: every cycle-free chain over sub- and equivalent classes; its assertion is that of the last step's class."""
    chains = f.g.table("all_paths")
    r = f.a_typ.join(chains.select("c", "d").distinct(), "c")
    last = F.get(c("nodes"), F.size("nodes") - 2)
    return path(f, r, "EXP-11", "SUBSUMPTION", c("s"), F.lit(TYPE), c("d"), F.concat(F.array(axiom("ClassAssertion", last, c("s"))), _step_axioms(c("nodes"))), F.concat(F.array(_type_of(c("s"), last)), _steps(c("nodes"), "rdfs:subClassOf")), chains=chains)


def deep_paths(f: Facts) -> DataFrame:
    """EXP-12: every chain over subclasses alone."""
    chains = f.g.table("deep_paths")
    r = f.a_typ.join(chains.select("c", "d").distinct(), "c")
    return path(f, r, "EXP-12", "SUBSUMPTION", c("s"), F.lit(TYPE), c("d"), F.concat(F.array(axiom("ClassAssertion", c("c"), c("s"))), _step_axioms(c("nodes"))), F.concat(F.array(_type_of(c("s"), c("c"))), _steps(c("nodes"), "rdfs:subClassOf")), chains=chains)


# -- classes from properties -------------------------------------------------------------------------------------------


def _domains(f: Facts) -> DataFrame:
    return f.g.table("domain").select("p", c("c").alias("d"))


def _ranges(f: Facts) -> DataFrame:
    return f.g.table("range").select("p", c("c").alias("d"))


def _one_value(rel: DataFrame) -> DataFrame:
    """The smallest value of each (s, p); minima are combined before the shuffle."""
    return rel.groupBy("s", "p").agg(F.min("o").alias("o"))


def domain_visit(f: Facts) -> DataFrame:
    """EXP-3"""
    r = _one_value(f.rel.join(_domains(f).select("p").distinct(), "p", "left_semi")).join(_domains(f), "p")
    return path(f, r, "EXP-3", "DOMAIN_RANGE", c("s"), F.lit(TYPE), c("d"), [axiom("PropertyAssertion", c("p"), c("s"), c("o")), axiom("Domain", c("p"), c("d"))], [_edge(c("s"), c("p"), c("o")), lit_text(c("p"), " Domain ", c("d"))])


def domain_entailed(f: Facts) -> DataFrame:
    """EXP-19: the domain axiom first."""
    r = _one_value(f.rel.join(_domains(f).select("p").distinct(), "p", "left_semi")).join(_domains(f), "p")
    return path(f, r, "EXP-19", "DOMAIN_RANGE", c("s"), F.lit(TYPE), c("d"), [axiom("Domain", c("p"), c("d")), axiom("PropertyAssertion", c("p"), c("s"), c("o"))], [_edge(c("s"), c("p"), c("o")), lit_text("domain(", c("p"), ") = ", c("d"))])


def _range(f: Facts, rel: DataFrame, strategy: str, one: bool) -> DataFrame:
    r = rel.join(_ranges(f), "p")
    r = r.groupBy("o", "p", "d").agg(F.min("s").alias("s")) if one else r
    return path(f, r, strategy, "DOMAIN_RANGE", c("o"), F.lit(TYPE), c("d"), [axiom("PropertyAssertion", c("p"), c("s"), c("o")), axiom("Range", c("p"), c("d"))], [_edge(c("s"), c("p"), c("o")), lit_text(c("p"), " Range ", c("d"))])


def range_visit(f: Facts) -> DataFrame:
    """EXP-4"""
    return _range(f, f.rel, "EXP-4", True)


def range_trace(f: Facts) -> DataFrame:
    """EXP-8: asserted subjects, all of them."""
    return _range(f, f.a_rel, "EXP-8", False)


def range_entailed(f: Facts) -> DataFrame:
    """EXP-27: entailed subjects, all of them."""
    return _range(f, f.rel, "EXP-27", False)


def property_trace(f: Facts) -> DataFrame:
    """EXP-7: (s, p, axioms, said): how a property of s rests on assertions, by the first source that gives one.

    Sources in order: an assertion, a sub-property (however that rests, nearest kind of source first), the inverse of an
    assertion or of what a sub-property of the inverse asserts, a chain of two assertions.  Within a source the smallest text
    wins, as the whole explanation is written: with the separator after each of its parts.
    """

    def rows(df: DataFrame, s, p, rank: int, said: list, axioms: list, inner=None) -> DataFrame:
        return df.select(s.alias("s"), p.alias("p"), F.lit(rank).alias("rank"), (F.lit(0) if inner is None else inner).alias("inner"), F.array(*said).alias("said"), F.array(*axioms).alias("axioms"))

    below = f.g.table("subproperty_closed").select(c("q").alias("p"), c("p").alias("q"))
    pairs = f.g.table("inverse")
    edge, held = _edge(c("s"), c("q"), c("o")), axiom("PropertyAssertion", c("q"), c("s"), c("o"))
    direct = rows(f.a_rel, c("s"), c("p"), 1, [_edge(c("s"), c("p"), c("o"))], [axiom("PropertyAssertion", c("p"), c("s"), c("o"))])
    turned, opposite = lit_text(F.least("p", "q"), " owl:inverseOf ", F.greatest("p", "q")), axiom("InverseProperties", F.least("p", "q"), F.greatest("p", "q"))
    inv = rows(f.a_rel.withColumnRenamed("p", "q").join(pairs, "q"), c("o"), c("p"), 3, [turned, edge], [opposite, held])
    deep = f.a_rel.withColumnRenamed("p", "r").join(below.select(c("q").alias("r"), c("p").alias("q")), "r").join(pairs, "q")
    deep = rows(deep, c("o"), c("p"), 3, [turned, lit_text(c("r"), " rdfs:subPropertyOf ", c("q")), _edge(c("s"), c("r"), c("o"))], [opposite, axiom("SubPropertyOf", c("r"), c("q")), axiom("PropertyAssertion", c("r"), c("s"), c("o"))], F.lit(1))
    two = rows(_two_links(f, f.a_rel), c("s"), c("p"), 4, [lit_text("PropertyChain(", c("p1"), " o ", c("p2"), ") -> ", c("p")), _edge(c("s"), c("p1"), c("z")), _edge(c("z"), c("p2"), c("o"))], [axiom("PropertyChain", c("p1"), c("p2"), c("p")), axiom("PropertyAssertion", c("p1"), c("s"), c("z")), axiom("PropertyAssertion", c("p2"), c("z"), c("o"))])
    own = reduce(DataFrame.unionByName, [direct, inv, deep, two])
    sub = own.withColumnRenamed("p", "q").join(below, "q").select("s", "p", F.lit(2).alias("rank"), (c("rank") * 10 + c("inner")).alias("inner"), F.concat(F.array(lit_text(c("q"), " rdfs:subPropertyOf ", c("p"))), "said").alias("said"), F.concat(F.array(axiom("SubPropertyOf", c("q"), c("p"))), "axioms").alias("axioms"))
    text = F.concat(F.array_join("said", "; "), F.lit("; ")).alias("text")
    best = own.unionByName(sub).groupBy("s", "p").agg(F.min(F.struct("rank", "inner", text, "said", "axioms")).alias("b"))
    return best.select("s", "p", "b.axioms", "b.said")


def domain_trace(f: Facts) -> DataFrame:
    """EXP-6"""
    r = property_trace(f).join(_domains(f), "p")
    return path(f, r, "EXP-6", "DOMAIN_RANGE", c("s"), F.lit(TYPE), c("d"), F.concat("axioms", F.array(axiom("Domain", c("p"), c("d")))), F.concat("said", F.array(lit_text(c("p"), " Domain ", c("d")))))


def _two_links(f: Facts, rel: DataFrame) -> DataFrame:
    """(s, p1, z, p2, o, p) for two-link chains; only facts of their links move."""
    a = rel.select("s", c("p").alias("p1"), c("o").alias("z")).join(f.g.table("two_links"), "p1")
    b = rel.select(c("s").alias("z"), c("p").alias("p2"), "o").join(f.g.table("two_links").select("p2"), "p2", "left_semi")
    return a.join(b, ["z", "p2"]).select("s", "p1", "z", "p2", "o", c("t").alias("p"))


def chain_domain(f: Facts) -> DataFrame:
    """EXP-22"""
    two = _two_links(f, f.rel).groupBy("s", "p1", "p2", "p").agg(F.min(F.struct("z", "o")).alias("m")).select("s", "p1", "p2", "p", "m.z", "m.o")
    r = two.join(_domains(f), "p")
    return path(f, r, "EXP-22", "PROPERTY_CHAIN", c("s"), F.lit(TYPE), c("d"), [axiom("PropertyAssertion", c("p1"), c("s"), c("z")), axiom("PropertyAssertion", c("p2"), c("z"), c("o")), axiom("PropertyChain", c("p1"), c("p2"), c("p")), axiom("Domain", c("p"), c("d"))], [_edge(c("s"), c("p1"), c("z")), _edge(c("z"), c("p2"), c("o")), lit_text(c("p1"), " o ", c("p2"), " SubPropertyOf ", c("p")), lit_text(c("p"), " Domain ", c("d"))])


def inverse_domain(f: Facts) -> DataFrame:
    """EXP-23: y Q x, P inverse of Q, domain(P) = C, the smallest y."""
    r = f.rel.withColumnRenamed("p", "q").join(f.g.table("inverse"), "q").join(_domains(f), "p").groupBy("o", "p", "q", "d").agg(F.min("s").alias("y"))
    return path(f, r, "EXP-23", "INVERSE_PROPERTY", c("o"), F.lit(TYPE), c("d"), [axiom("PropertyAssertion", c("q"), c("y"), c("o")), axiom("InverseProperties", F.least("p", "q"), F.greatest("p", "q")), axiom("Domain", c("p"), c("d"))], [_edge(c("y"), c("q"), c("o")), lit_text(c("p"), " InverseOf ", c("q")), lit_text(c("p"), " Domain ", c("d"))])


def functional_range(f: Facts) -> DataFrame:
    """EXP-24: the range of a functional property is claimed of its subject, where that is entailed anyway."""
    r = _one_value(f.g.having(f.rel, "functional")).join(_ranges(f), "p")
    return path(f, r, "EXP-24", "FUNCTIONAL_PROPERTY", c("s"), F.lit(TYPE), c("d"), [axiom("PropertyAssertion", c("p"), c("s"), c("o")), axiom("FunctionalProperty", c("p")), axiom("Range", c("p"), c("d"))], [_edge(c("s"), c("p"), c("o")), lit_text("Functional: ", c("p")), lit_text(c("p"), " Range ", c("d"))])


def symmetric_domain(f: Facts) -> DataFrame:
    """EXP-25: y P x with y other than x, the smallest y."""
    r = f.g.having(f.rel.where("s <> o"), "symmetric").join(_domains(f), "p").groupBy("o", "p", "d").agg(F.min("s").alias("y"))
    return path(f, r, "EXP-25", "SYMMETRIC_PROPERTY", c("o"), F.lit(TYPE), c("d"), [axiom("PropertyAssertion", c("p"), c("y"), c("o")), axiom("SymmetricProperty", c("p")), axiom("Domain", c("p"), c("d"))], [_edge(c("y"), c("p"), c("o")), lit_text("Symmetric: ", c("p")), lit_text(c("p"), " Domain ", c("d"))])


def subproperty_domain(f: Facts) -> DataFrame:
    """EXP-26"""
    subs = f.g.table("subproperty")
    r = _one_value(f.rel.join(subs.select(c("q").alias("p")).distinct(), "p", "left_semi")).withColumnRenamed("p", "q").join(subs, "q").join(_domains(f), "p")
    return path(f, r, "EXP-26", "SUBPROPERTY", c("s"), F.lit(TYPE), c("d"), [axiom("PropertyAssertion", c("q"), c("s"), c("o")), axiom("SubPropertyOf", c("q"), c("p")), axiom("Domain", c("p"), c("d"))], [_edge(c("s"), c("q"), c("o")), lit_text(c("q"), " SubPropertyOf ", c("p")), lit_text(c("p"), " Domain ", c("d"))])


# -- classes from expressions ------------------------------------------------------------------------------------------


def intersection_evidence(f: Facts) -> DataFrame:
    """EXP-14: members of all named operands (two or more operands); asserted memberships, one at least, are the evidence."""
    t = f.g.table("and_below")
    member = f.typ.join(t, "c").join(f.a_typ.select("s", "c", F.lit(True).alias("told")), ["s", "c"], "left")
    r = member.groupBy("s", "d", "x", "n", "k").agg(F.count("*").alias("m"), F.array_sort(F.collect_list(F.when(c("told"), c("c")))).alias("ops")).where("m = k and size(ops) > 0")
    ax = F.concat(F.array(axiom("Expression", c("d"), c("x"))), F.transform("ops", lambda o: F.struct(F.lit("ClassAssertion").alias("kind"), F.array(o, c("s")).alias("args"))))
    said = F.concat(F.transform("ops", lambda o: F.concat(c("s"), F.lit(" rdf:type "), o)), F.array(lit_text("Intersection satisfied: member of all ", c("n").cast("string"), " components")))
    return path(f, r, "EXP-14", "INTERSECTION", c("s"), F.lit(TYPE), c("d"), ax, said)


def _typed(typ: DataFrame, table: DataFrame) -> DataFrame:
    """(o, f): members of the fillers of a table, the only types that its joins need."""
    return typ.select(c("s").alias("o"), c("c").alias("f")).join(table.select("f"), "f", "left_semi")


def existential_evidence(f: Facts) -> DataFrame:
    """EXP-15: the smallest witness with asserted evidence (edge, type, or both)."""
    some = f.g.table("some_of")
    told = f.a_rel.join(some.select("p"), "p", "left_semi").select("s", "p", "o", F.lit(True).alias("e1"))
    r = f.rel.join(some, "p").join(_typed(f.typ, some), ["o", "f"]).join(_typed(f.a_typ, some).withColumn("e2", F.lit(True)), ["o", "f"], "left").join(told, ["s", "p", "o"], "left")
    r = r.where("e1 or e2").groupBy("s", "d", "x", "p", "f").agg(F.min(F.struct("o", "e1", "e2")).alias("m")).select("s", "d", "x", "p", "f", "m.*")
    ax = F.array_compact(F.array(F.when(c("e1"), axiom("PropertyAssertion", c("p"), c("s"), c("o"))), F.when(c("e2"), axiom("ClassAssertion", c("f"), c("o"))), axiom("Expression", c("d"), c("x"))))
    said = F.array_compact(F.array(F.when(c("e1"), _edge(c("s"), c("p"), c("o"))), F.when(c("e2"), _type_of(c("o"), c("f"))), lit_text("some ", c("p"), ".", c("f"), " restriction satisfied by ", c("o"))))
    return path(f, r, "EXP-15", "EXISTENTIAL", c("s"), F.lit(TYPE), c("d"), ax, said)


def existential_entailed(f: Facts) -> DataFrame:
    """EXP-18, existential part: the smallest entailed witness."""
    some = f.g.table("some_of")
    r = f.rel.join(some, "p").join(_typed(f.typ, some), ["o", "f"])
    r = r.groupBy("s", "d", "x", "p", "f").agg(F.min("o").alias("o"))
    ax = [axiom("PropertyAssertion", c("p"), c("s"), c("o")), axiom("ClassAssertion", c("f"), c("o")), axiom("Expression", c("d"), c("x"))]
    return path(f, r, "EXP-18", "EXISTENTIAL", c("s"), F.lit(TYPE), c("d"), ax, [_edge(c("s"), c("p"), c("o")), _type_of(c("o"), c("f")), lit_text("some ", c("p"), ".", c("f"), " restriction satisfied")])


def _vacuous(f: Facts, strategy: str) -> DataFrame:
    t = f.g.table("all_of")
    r = f.typ.withColumnRenamed("c", "d").join(t, "d").join(f.rel.join(t.select("p"), "p", "left_semi").select("s", "p"), ["s", "p"], "left_anti")
    return path(f, r, strategy, "UNIVERSAL", c("s"), F.lit(TYPE), c("d"), [axiom("Expression", c("d"), c("x"))], [lit_text("No ", c("p"), " values for ", c("s")), lit_text("all ", c("p"), ".", c("f"), " vacuously satisfied")])


def universal_evidence(f: Facts) -> DataFrame:
    """EXP-16: no known value, or all known values of the filler, with asserted evidence."""
    r = f.typ.withColumnRenamed("c", "d").join(f.g.table("all_of"), "d").join(f.rel, ["s", "p"])
    r = r.join(f.typ.select(c("s").alias("o"), c("c").alias("f"), F.lit(1).alias("ok")), ["o", "f"], "left").join(f.a_rel.select("s", "p", "o", F.lit(True).alias("e1")), ["s", "p", "o"], "left").join(f.a_typ.select(c("s").alias("o"), c("c").alias("f"), F.lit(True).alias("e2")), ["o", "f"], "left")
    both = F.when(c("e1") & c("e2"), F.struct("o"))
    r = r.groupBy("s", "d", "x", "p", "f").agg(F.count("*").alias("n"), F.count("ok").alias("m"), F.array_sort(F.collect_list(both)).alias("os")).where("n = m and size(os) > 0").withColumnsRenamed({"s": "x0", "p": "q"})
    ax = F.concat(F.flatten(F.transform("os", lambda o: F.array(F.struct(F.lit("PropertyAssertion").alias("kind"), F.array(c("q"), c("x0"), o["o"]).alias("args")), F.struct(F.lit("ClassAssertion").alias("kind"), F.array(c("f"), o["o"]).alias("args"))))), F.array(axiom("Expression", c("d"), c("x"))))
    said = F.concat(F.flatten(F.transform("os", lambda o: F.array(F.concat(c("x0"), F.lit(" "), c("q"), F.lit(" "), o["o"]), F.concat(o["o"], F.lit(" rdf:type "), c("f"))))), F.array(lit_text("all ", c("q"), ".", c("f"), " satisfied by all ", c("n").cast("string"), " values")))
    return path(f, r, "EXP-16", "UNIVERSAL", c("x0"), F.lit(TYPE), c("d"), ax, said).unionByName(_vacuous(f, "EXP-16"))


def universal_vacuous(f: Facts) -> DataFrame:
    """EXP-18, universal part."""
    return _vacuous(f, "EXP-18")


def property_based(f: Facts) -> DataFrame:
    """EXP-18"""
    return existential_entailed(f).unionByName(universal_vacuous(f))


def constructors(f: Facts) -> DataFrame:
    """EXP-20: member of all named operands (two or more of them) of an intersection; first operand of a union that has it."""
    t = f.g.table("and_equal")
    r = f.typ.join(t, "c").groupBy("s", "d", "x", "k").agg(F.count("*").alias("m"), F.array_sort(F.collect_list("c")).alias("ops")).where("m = k")
    ax = F.concat(F.array(axiom("Expression", c("d"), c("x"))), F.transform("ops", lambda o: F.struct(F.lit("ClassAssertion").alias("kind"), F.array(o, c("s")).alias("args"))))
    one = path(f, r, "EXP-20", "INTERSECTION", c("s"), F.lit(TYPE), c("d"), ax, F.transform("ops", lambda o: F.concat(c("s"), F.lit(" rdf:type "), o)))
    r = f.typ.join(f.g.table("or_equal"), "c").groupBy("s", "d", "x").agg(F.min("c").alias("c"))
    two = path(f, r, "EXP-20", "UNION", c("s"), F.lit(TYPE), c("d"), [axiom("Expression", c("d"), c("x")), axiom("ClassAssertion", c("c"), c("s"))], [_type_of(c("s"), c("c")), lit_text("Union class membership via ", c("c"))])
    return one.unionByName(two)


def complex_intersection(f: Facts) -> DataFrame:
    """EXP-21: intersections that mix named operands and existentials; two or more satisfied operands are told."""
    tn, ts = f.g.table("mixed_named"), f.g.table("mixed_some")
    none = F.lit(None).cast("string")
    a = f.typ.join(tn, "c").select("s", "d", "x", "k", "c", none.alias("p"), none.alias("f"), none.alias("o"))
    b = f.rel.join(ts, "p").join(_typed(f.typ, ts), ["o", "f"]).groupBy("s", "d", "x", "k", "p", "f").agg(F.min("o").alias("o")).select("s", "d", "x", "k", none.alias("c"), "p", "f", "o")
    r = a.unionByName(b).groupBy("s", "d", "x").agg(F.array_sort(F.collect_list(F.struct("k", "c", "p", "f", "o"))).alias("parts")).where("size(parts) >= 2").withColumnRenamed("s", "x0")
    is_type = lambda o, t: F.struct(F.lit("ClassAssertion").alias("kind"), F.array(t, o).alias("args"))
    says_type = lambda o, t: F.concat(o, F.lit(" rdf:type "), t)
    told_axioms = lambda q: F.when(q["c"].isNotNull(), F.array(is_type(c("x0"), q["c"]))).otherwise(F.array(F.struct(F.lit("PropertyAssertion").alias("kind"), F.array(q["p"], c("x0"), q["o"]).alias("args")), is_type(q["o"], q["f"])))
    told_texts = lambda q: F.when(q["c"].isNotNull(), F.array(says_type(c("x0"), q["c"]))).otherwise(F.array(F.concat(c("x0"), F.lit(" "), q["p"], F.lit(" "), q["o"]), says_type(q["o"], q["f"])))
    ax = F.concat(F.array(axiom("Expression", c("d"), c("x"))), F.flatten(F.transform("parts", told_axioms)))
    said = F.concat(F.flatten(F.transform("parts", told_texts)), F.array(lit_text("Complex intersection satisfied (", F.size("parts").cast("string"), " components)")))
    return path(f, r, "EXP-21", "INTERSECTION", c("x0"), F.lit(TYPE), c("d"), ax, said)


# -- relations ---------------------------------------------------------------------------------------------------------


def direct_relation(f: Facts) -> DataFrame:
    """EXP-30"""
    return path(f, f.a_rel, "EXP-30", "DIRECT_ASSERTION", c("s"), c("p"), c("o"), [axiom("PropertyAssertion", c("p"), c("s"), c("o"))], [_edge(c("s"), c("p"), c("o"))], 1)


def subproperty_relation(f: Facts) -> DataFrame:
    """EXP-31"""
    r = f.rel.withColumnRenamed("p", "q").join(f.g.table("subproperty"), "q")
    return path(f, r, "EXP-31", "SUBPROPERTY", c("s"), c("p"), c("o"), [axiom("PropertyAssertion", c("q"), c("s"), c("o")), axiom("SubPropertyOf", c("q"), c("p"))], [_edge(c("s"), c("q"), c("o")), lit_text(c("q"), " rdfs:subPropertyOf ", c("p"))])


def symmetric_relation(f: Facts) -> DataFrame:
    """EXP-32: y P x gives x P y, also for x = y."""
    r = f.g.having(f.rel, "symmetric").select(c("o").alias("s"), "p", c("s").alias("o"))
    return path(f, r, "EXP-32", "SYMMETRIC_PROPERTY", c("s"), c("p"), c("o"), [axiom("PropertyAssertion", c("p"), c("o"), c("s")), axiom("SymmetricProperty", c("p"))], [_edge(c("o"), c("p"), c("s")), lit_text("SymmetricObjectProperty(", c("p"), ")")])


def transitive_relation(f: Facts) -> DataFrame:
    """EXP-33: the smallest middle z other than y (it may be x)."""
    a = f.g.having(f.rel, "transitive")
    r = a.select("s", "p", c("o").alias("z")).join(a.select(c("s").alias("z"), "p", "o"), ["z", "p"]).where("z <> o").groupBy("s", "p", "o").agg(F.min("z").alias("z"))
    return path(f, r, "EXP-33", "TRANSITIVE_PROPERTY", c("s"), c("p"), c("o"), [axiom("PropertyAssertion", c("p"), c("s"), c("z")), axiom("PropertyAssertion", c("p"), c("z"), c("o")), axiom("TransitiveProperty", c("p"))], [_edge(c("s"), c("p"), c("z")), _edge(c("z"), c("p"), c("o")), lit_text("TransitiveObjectProperty(", c("p"), ")")])


def inverse_relation(f: Facts) -> DataFrame:
    """EXP-34"""
    r = f.rel.withColumnRenamed("p", "q").join(f.g.table("inverse"), "q").select(c("o").alias("s"), "p", "q", c("s").alias("o"))
    return path(f, r, "EXP-34", "INVERSE_PROPERTY", c("s"), c("p"), c("o"), [axiom("PropertyAssertion", c("q"), c("o"), c("s")), axiom("InverseProperties", F.least("p", "q"), F.greatest("p", "q"))], [_edge(c("o"), c("q"), c("s")), lit_text(c("p"), " owl:inverseOf ", c("q"))])


def chain_relation(f: Facts) -> DataFrame:
    """EXP-35: two-link chains, the smallest middle."""
    r = _two_links(f, f.rel).groupBy("s", "p1", "p2", "p", "o").agg(F.min("z").alias("z"))
    return path(f, r, "EXP-35", "PROPERTY_CHAIN", c("s"), c("p"), c("o"), [axiom("PropertyChain", c("p1"), c("p2"), c("p")), axiom("PropertyAssertion", c("p1"), c("s"), c("z")), axiom("PropertyAssertion", c("p2"), c("z"), c("o"))], [_edge(c("s"), c("p1"), c("z")), _edge(c("z"), c("p2"), c("o")), lit_text("PropertyChain(", c("p1"), " o ", c("p2"), ") -> ", c("p"))])


CLASS_STRATEGIES: dict[str, Callable[[Facts], DataFrame]] = {
    "EXP-1": subclass_visit, "EXP-2": equivalent_visit, "EXP-3": domain_visit, "EXP-4": range_visit, "EXP-6": domain_trace, "EXP-8": range_trace, "EXP-9": subclass_trace, "EXP-10": hierarchy_search,
    "EXP-11": subclass_paths, "EXP-12": deep_paths, "EXP-14": intersection_evidence, "EXP-15": existential_evidence, "EXP-16": universal_evidence, "EXP-17": equivalent_class, "EXP-18": property_based,
    "EXP-19": domain_entailed, "EXP-20": constructors, "EXP-21": complex_intersection, "EXP-22": chain_domain, "EXP-23": inverse_domain, "EXP-24": functional_range, "EXP-25": symmetric_domain,
    "EXP-26": subproperty_domain, "EXP-27": range_entailed, "EXP-28": direct_type,
}
RELATION_STRATEGIES: dict[str, Callable[[Facts], DataFrame]] = {
    "EXP-30": direct_relation, "EXP-31": subproperty_relation, "EXP-32": symmetric_relation, "EXP-33": transitive_relation, "EXP-34": inverse_relation, "EXP-35": chain_relation,
}


#: More strategies than this are run one by one and their paths written, so that no plan holds them all.
ONE_PLAN = 4


def _told_once(f: Facts) -> Facts:
    """Assertions may be told twice; each is explained once."""
    return replace(f, a_typ=f.a_typ.select("s", "c").distinct(), a_rel=f.a_rel.select("s", "p", "o").distinct())


def explain(f: Facts, strategy: str) -> DataFrame:
    """The path rows of one strategy for entailed targets."""
    return (CLASS_STRATEGIES | RELATION_STRATEGIES)[strategy](_told_once(f))


def written(f: Facts, strategies: list[str], form: Callable[[DataFrame], DataFrame]) -> list[tuple[Callable[[Facts, DataFrame], DataFrame], DataFrame]]:
    """The paths of class and of relation strategies in the given form, a table of each written strategy by strategy, and
    the semi-join that leaves those of entailed targets."""
    once = _told_once(f)
    # Assertions are made distinct once, not by each strategy that reads them.
    f, out = replace(once, a_typ=settle(once.a_typ), a_rel=settle(once.a_rel), checked=False), []
    for known, held in ((CLASS_STRATEGIES, _entailed_types), (RELATION_STRATEGIES, _entailed_relations)):
        own = [form(known[n](f)) for n in strategies if n in known]
        out += [(held, settle_all(own))] if own else []
    release(f.a_typ, f.a_rel)
    return out


def per_target(f: Facts, tables: list[tuple[Callable[[Facts, DataFrame], DataFrame], DataFrame]], *aggregates: Column) -> DataFrame:
    """Aggregates of the written paths of each entailed target.  Paths are combined before the semi-join, which so sees a
    target once; class targets are told apart by (s, o), the keys of their semi-join, so they are shuffled once for both."""
    out = []
    for held, table in tables:
        keys = ["s", "o"] if held is _entailed_types else ["s", "p", "o"]
        found = held(f, table.groupBy(*keys).agg(*aggregates))
        out.append(found if "p" in keys else found.withColumn("p", F.lit(TYPE)))
    return reduce(DataFrame.unionByName, [t.select("s", "p", "o", *[n for n in t.columns if n not in ("s", "p", "o")]) for t in out])


def explain_all(f: Facts, strategies: list[str] | None = None, form: Callable[[DataFrame], DataFrame] = lambda paths: paths) -> DataFrame:
    """All path rows (EXP-13, EXP-42: only explained inferences appear), or what ``form`` makes of them (it keeps s, p, o).

    Many strategies are written one by one, then there is one semi-join with what is entailed for types and one for relations.
    """
    names = strategies or [*CLASS_STRATEGIES, *RELATION_STRATEGIES]
    if len(names) <= ONE_PLAN:
        return reduce(DataFrame.unionByName, [form(explain(f, n)) for n in names])
    return reduce(DataFrame.unionByName, [held(f, table) for held, table in written(f, names, form)])


# -- path sets ---------------------------------------------------------------------------------------------------------


def axiom_text(a: Column) -> Column:
    """PRJ-11: an axiom's plain form; kinds without a form of their own read as kind(arguments)."""
    k, x = a["kind"], a["args"]
    first, second, third = F.get(x, F.lit(0)), F.get(x, F.lit(1)), F.get(x, F.lit(2))
    return (
        F.when(k == "ClassAssertion", F.concat(second, F.lit(" rdf:type "), first))
        .when(k == "PropertyAssertion", F.concat(second, F.lit(" "), first, F.lit(" "), third))
        .when(k == "SubClassOf", F.concat(first, F.lit(" rdfs:subClassOf "), second))
        .when(k == "SubPropertyOf", F.concat(first, F.lit(" rdfs:subPropertyOf "), second))
        .when(k == "EquivalentClasses", F.array_join(F.array_sort(x), " owl:equivalentClass "))
        .when(k == "InverseProperties", F.array_join(F.array_sort(x), " owl:inverseOf "))
        .when(k == "Domain", F.concat(F.lit("domain("), first, F.lit(") = "), second))
        .when(k == "Range", F.concat(F.lit("range("), first, F.lit(") = "), second))
        .when(k == "TransitiveProperty", F.concat(F.lit("TransitiveObjectProperty("), first, F.lit(")")))
        .when(k == "SymmetricProperty", F.concat(F.lit("SymmetricObjectProperty("), first, F.lit(")")))
        .when(k == "FunctionalProperty", F.concat(F.lit("FunctionalObjectProperty("), first, F.lit(")")))
        .otherwise(F.concat(k, F.lit("("), F.array_join(x, " "), F.lit(")")))
    )


def signature(kind: Column, axioms: Column) -> Column:
    """EXP-40: type and sorted axioms in normal form."""

    def normal(a: Column) -> Column:
        k, x = a["kind"], a["args"]
        name = F.when(k == "PropertyAssertion", "PROP").when(k == "Domain", "DOMAIN").when(k == "Range", "RANGE").when(k == "ClassAssertion", "CLASS").when(k == "SubClassOf", "SUBCLASS").when(k == "EquivalentClasses", "EQUIV").otherwise("OTHER")
        return F.concat(name, F.lit(":"), F.when(name == "OTHER", F.concat(k, F.lit(":"))).otherwise(""), F.array_join(F.when(k == "EquivalentClasses", F.array_sort(x)).otherwise(x), ","))

    return F.concat_ws(";", kind, F.array_join(F.array_sort(F.transform(axioms, normal)), ";"))


def deduplicate(paths: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """EXP-41: one path of each target and signature: the longer description, then more axioms, then the smaller text.

    With ``columns`` only these of the path left, besides its keys; the others are not carried along.

    One aggregate with map-side combine; no group of paths is sorted.
    """
    rows = paths.withColumn("signature", signature(c("type"), c("axioms"))).withColumn("description", F.array_join("justifications", "; "))
    keys = ["s", "p", "o", "signature"]
    order = [(-F.length("description")).alias("_a"), (-F.size("axioms")).alias("_b"), F.col("description"), F.col("strategy")]
    rest = [n for n in rows.columns if n not in (*keys, "description", "strategy") and (columns is None or n in columns)]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return best.select(*[F.col(n) if n in keys else F.col(f"m.{n}").alias(n) for n in rows.columns if n in keys or columns is None or n in columns])


def justification_list(said: Column, axioms: Column, description: Column) -> Column:
    """EXP-43: justifications, else the axioms' texts, else the description, else a constant."""
    return F.when(F.size(said) > 0, said).when(F.size(axioms) > 0, F.transform(axioms, axiom_text)).when(F.length(description) > 0, F.array(description)).otherwise(F.array(F.lit("No explanation available")))


def _sizes() -> list[Column]:
    return [F.min("complexity").alias("min_size"), F.max("complexity").alias("max_size"), F.count("*").alias("explanation_count")]


def sizes(paths: DataFrame) -> DataFrame:
    """EXP-44: smallest and largest complexity and number of paths of each target."""
    return paths.groupBy("s", "p", "o").agg(*_sizes())


def sizes_of(f: Facts, strategies: list[str]) -> DataFrame:
    """``sizes`` of the paths of many strategies; neither axioms nor texts are written."""
    return per_target(f, written(f, strategies, lambda paths: paths.select("s", "p", "o", "complexity")), *_sizes())
