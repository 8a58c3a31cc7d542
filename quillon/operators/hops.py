"""Subgraph extraction (JN-1 .. JN-5) and graph sizes (AGG-1, AGG-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.model import THING, Graph
from quillon.operators.reasoning import apart_groups
from quillon.plans.lineage import settle


def axioms(g: Graph) -> DataFrame:
    """(axiom, individuals) of all assertions: the key of an axiom is its text."""
    rel = g.relations.select(F.concat_ws("|", "p", "s", "o").alias("axiom"), F.array_distinct(F.array("s", "o")).alias("individuals"))
    return rel.unionByName(g.types.select(F.concat_ws("|", F.lit("rdf:type"), "s", "c").alias("axiom"), F.array("s").alias("individuals")))


def mentions(g: Graph, extra: DataFrame | None = None) -> DataFrame:
    """(x, axiom) for every individual of every axiom; one pass for all individuals (FLT-2)."""
    rows = axioms(g) if extra is None else axioms(g).unionByName(extra)
    return rows.select(F.explode("individuals").alias("x"), "axiom").distinct()


def hop(g: Graph, k: int, start: Column | None = None) -> DataFrame:
    """(x, axiom) of the one- or two-hop modules of the individuals chosen by ``start`` (JN-1, JN-2).

    Two hops go from x to the distinct individuals of its axioms and from there to their axioms, so several axioms
    between two individuals cost one row.  An axiom of n individuals makes each a neighbour of all others, as it does
    in the result; ``start`` bounds for whom that is written.
    """
    one = mentions(g)
    from_ = one if start is None else one.where(start)
    if k == 1:
        return from_
    near = from_.join(one.select(F.col("x").alias("y"), "axiom"), "axiom").select("x", "y").distinct()
    return near.join(one.select(F.col("x").alias("y"), "axiom"), "y").select("x", "axiom").distinct()


def hop2_blocks(g: Graph) -> tuple[DataFrame, DataFrame]:
    """JN-2 without its product: (x, y) for the individuals y of the axioms of x, and (y, axiom) for the axioms of y.

    The two-hop module of x is the union of the blocks of its y; a block is written once, however many modules share it,
    so a hub of n individuals costs n rows and not their square.
    """
    two = axioms(g).where("size(individuals) > 1").distinct()
    ends = two.select(F.explode("individuals").alias("x"), "individuals")
    near = ends.select("x", F.explode("individuals").alias("y")).unionByName(mentions(g).select("x", F.col("x").alias("y"))).distinct()
    return near, mentions(g).withColumnRenamed("x", "y")


def hop2_counts(g: Graph) -> DataFrame:
    """(x, n_axioms): the number of axioms of each two-hop module, from degrees alone.

    The degrees of x's neighbours (and its own) add up to each axiom once for every individual it has among them.  An
    axiom has two at most, so those between two of them are taken off once: the axioms of x itself that have two, and those
    between two neighbours, which are the triangles at x, found from each edge over its end of lower degree.
    """
    one = mentions(g)
    degree = one.groupBy("x").agg(F.count("*").alias("n"))
    two = settle(axioms(g).where("size(individuals) > 1").distinct().select("axiom", F.array_min("individuals").alias("a"), F.array_max("individuals").alias("b")))
    edge = settle(two.groupBy("a", "b").agg(F.count("*").alias("m")))
    both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"), "m"))
    of = degree.withColumnRenamed("x", "b").withColumnRenamed("n", "d")
    summed = both.join(of, "b").groupBy(F.col("a").alias("x")).agg((F.sum("d") - F.sum("m")).alias("n"))
    # Triangles: both other ends of an edge's lower end are sought, so a hub is met from its neighbours.
    rank = settle(both.join(of, "b").select(F.col("b").alias("v"), F.col("d")).distinct())
    low = edge.join(rank.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(rank.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct(F.col("da").alias("d"), F.col("a").alias("v")) < F.struct(F.col("db").alias("d"), F.col("b").alias("v"))
    out = settle(low.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), "m"))
    pair = out.alias("p").join(out.alias("q"), (F.col("p.u") == F.col("q.u")) & (F.col("p.v") < F.col("q.v"))).select(F.col("p.u").alias("u"), F.col("p.v").alias("a"), F.col("q.v").alias("b"), F.col("p.m").alias("ua"), F.col("q.m").alias("ub"))
    closed = pair.join(edge, ["a", "b"])
    inner = closed.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m")), F.struct(F.col("b").alias("x"), F.col("ua").alias("m")), F.struct(F.col("a").alias("x"), F.col("ub").alias("m")))).alias("t")).groupBy("t.x").agg(F.sum("t.m").alias("k"))
    rows = degree.join(summed.withColumnRenamed("n", "more"), "x", "left").join(inner, "x", "left")
    return rows.select("x", (F.col("n") + F.coalesce("more", F.lit(0)) - F.coalesce("k", F.lit(0))).alias("n_axioms"))


def neighbours(g: Graph) -> DataFrame:
    """JN-4: (s, o) in both directions, of relations and of asserted equalities."""
    e = g.relations.select("s", "o")
    if g.same is not None:
        e = e.unionByName(g.same.select(F.col("a").alias("s"), F.col("b").alias("o")))
    return e.unionByName(e.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct()


def reach(g: Graph, start: DataFrame, k: int) -> DataFrame:
    """JN-3: (x, y) for y within k steps of x, breadth first; each step joins only the last frontier.

    The members of an axiom of different individuals are one step apart; a step goes over the axiom, so an axiom of n
    individuals costs n rows and not its pairs.
    """
    edge, apart = neighbours(g), apart_groups(g)
    seen = start.select("x", F.col("x").alias("y"))
    front = seen
    for _ in range(k):
        step = front.join(edge, front["y"] == edge["s"]).select("x", F.col("o").alias("y"))
        if apart is not None:
            by = front.join(apart, front["y"] == apart["s"]).select("x", "axiom").distinct()
            step = step.unionByName(by.join(apart, "axiom").select("x", F.col("s").alias("y")))
        front = settle(step.distinct().join(seen, ["x", "y"], "left_anti"))
        seen = seen.unionByName(front)
    return seen


def schema_axioms(g: Graph) -> list[str]:
    """The texts of all axioms without individuals (JN-5: every module holds them)."""
    s = g.schema
    named = (("SubClassOf", s.subclass), ("EquivalentTo", s.equivalent), ("DisjointWith", s.disjoint), ("SubPropertyOf", s.subproperty), ("EquivalentProperty", s.equivalent_property), ("DisjointProperty", s.disjoint_property), ("InverseOf", s.inverse), ("Domain", s.domain), ("Range", s.range))
    kinds = (("Symmetric", s.symmetric), ("Transitive", s.transitive), ("Functional", s.functional), ("InverseFunctional", s.inverse_functional), ("Reflexive", s.reflexive), ("Irreflexive", s.irreflexive), ("Asymmetric", s.asymmetric))
    out = [f"{kind}|{a}|{b}" for kind, rows in named for a, b in rows] + [f"{kind}|{p}" for kind, rows in kinds for p in rows]
    return sorted({*out, *(f"PropertyChain|{' o '.join(links)}|{t}" for links, t in s.chains), *(f"HasKey|{c}|{','.join(ps)}" for c, ps in s.keys)})


def with_schema(g: Graph, modules: DataFrame) -> DataFrame:
    """JN-5: modules (x, axiom) with the schema's axioms in each; the schema is a bounded, broadcast table."""
    every = g.small([(a,) for a in schema_axioms(g)], "axiom string")
    return modules.select("x", "axiom").unionByName(modules.select("x").distinct().crossJoin(every))


def module(g: Graph, k: int, start: DataFrame) -> DataFrame:
    """(x, axiom) of modules of any radius: axioms all of whose individuals are within k steps of x (FLT-3)."""
    near = reach(g, start, k)
    size = axioms(g).select("axiom", F.size("individuals").alias("n")).distinct()
    hit = mentions(g).withColumnRenamed("x", "y").join(near, "y").groupBy("x", "axiom").agg(F.count("*").alias("m"))
    return hit.join(size, "axiom").where("m = n").select("x", "axiom")


def totals(sized: DataFrame) -> DataFrame:
    """AGG-2: (kind, n, mean) over many ontologies' sizes (graph_id, kind, n)."""
    return sized.groupBy("kind").agg(F.sum("n").cast("bigint").alias("n"), F.round(F.avg("n"), 4).alias("mean"))


def sizes(g: Graph) -> DataFrame:
    """Numbers of individuals, named classes (without Thing) and properties."""
    s = g.schema
    pairs = [*s.subclass, *s.equivalent, *s.disjoint]
    named = {c for p in pairs for c in p if s.named(c)} | {c for _, c in [*s.domain, *s.range]}
    named |= {o for e in s.expressions.values() for o in (*e.operands, e.filler) if o and s.named(o)} - {THING}
    props = {p for p, _ in [*s.domain, *s.range]} | {p for x in [*s.subproperty, *s.inverse, *s.equivalent_property] for p in x} | {*s.symmetric, *s.transitive, *s.functional}
    props |= {x for links, t in s.chains for x in (*links, t)}
    people = g.types.select("s").unionByName(g.relations.select("s")).unionByName(g.relations.select(F.col("o").alias("s"))).agg(F.countDistinct("s").alias("n"))
    rows = g.spark.createDataFrame([("classes", len(named)), ("properties", len(props | {"hasPart", "suppliedBy"}))], "kind string, n bigint")
    return people.select(F.lit("individuals").alias("kind"), "n").unionByName(rows)
