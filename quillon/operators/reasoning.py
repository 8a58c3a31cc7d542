"""Entailment by rules of OWL 2 RL, set at a time (RSN-0 .. RSN-23).

Every rule is a function of DataFrames that yields derived rows.  The schema enters as tables (``Graph.table``): of one schema
that the driver holds, or of many graphs' schemas as rows (``graphs``).  Chains of sub-, inverse, equivalent and symmetric
properties and of the class hierarchy are closed beforehand and applied by one join; only
transitivity, chains, equalities and class expressions iterate over facts, on the new rows of the last round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.model import THING, Graph, Schema, closed
from quillon.plans.lineage import settle

REL, TYP = ("s", "p", "o"), ("s", "c")
#: A fixpoint that has not ended after so many rounds is a fault; known rows are rewritten as one table every COMPACT rounds.
GUARD, COMPACT = 100_000, 8


def rounds(what: str) -> Iterator[int]:
    """Round numbers until the caller's fixpoint ends; an error instead of a silent stop."""
    for k in count():
        if k >= GUARD:
            raise RuntimeError(f"{what} did not end after {GUARD} rounds")
        yield k


def union(parts: list[DataFrame], columns) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


# -- relations ---------------------------------------------------------------------------------------------------------


def apply_property_steps(g: Graph, rel: DataFrame) -> DataFrame:
    """RSN-3/4/5/6: sub-, equivalent, inverse and symmetric properties, closed, in one broadcast join."""
    if not g.has("steps"):
        return rel.limit(0)
    return rel.join(g.table("steps"), "p").select(F.when(F.col("swap"), F.col("o")).otherwise(F.col("s")).alias("s"), F.col("q").alias("p"), F.when(F.col("swap"), F.col("s")).otherwise(F.col("o")).alias("o"))


def sub_property(g: Graph, rel: DataFrame) -> DataFrame:
    return rel.join(g.table("subproperty_closed"), "p").select("s", F.col("q").alias("p"), "o").distinct()


def inverse(g: Graph, rel: DataFrame) -> DataFrame:
    return rel.join(g.table("inverse"), "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o")).distinct()


def symmetric(g: Graph, rel: DataFrame) -> DataFrame:
    return g.having(rel, "symmetric").select(F.col("o").alias("s"), "p", F.col("s").alias("o")).distinct()


def transitive_step(g: Graph, new: DataFrame, known: DataFrame) -> DataFrame:
    """New facts one step longer: new after known and known after new (the same where all known rows are new)."""
    a, b = g.having(new, "transitive"), g.having(known, "transitive")
    one = a.alias("x").join(b.alias("y"), (F.col("x.o") == F.col("y.s")) & (F.col("x.p") == F.col("y.p"))).select("x.s", "x.p", "y.o")
    if new is known:
        return one
    two = b.alias("x").join(a.alias("y"), (F.col("x.o") == F.col("y.s")) & (F.col("x.p") == F.col("y.p"))).select("x.s", "x.p", "y.o")
    return one.unionByName(two)


def transitive_closure(g: Graph, rel: DataFrame) -> DataFrame:
    """RSN-7: all facts of transitive properties, by semi-naive rounds; cycles end as no row is new."""
    known = settle(g.having(rel, "transitive").select(*REL).distinct())
    new = known
    for k in rounds("a transitive closure"):
        new = settle(transitive_step(g, new, known).distinct().join(known, list(REL), "left_anti"))
        if new.isEmpty():
            return known
        known = _grown(known, new, k)


def _grown(known: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Known rows and the new ones; as one table every COMPACT rounds, so that plans do not widen with the rounds."""
    both = known.unionByName(new)
    return settle(both) if k % COMPACT == COMPACT - 1 else both


def chain(g: Graph, rel: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """RSN-8: property chains of any length, all chains link by link in one join a link.

    With ``new`` (a part of ``rel``) only paths with a new fact: each link in turn is taken from it.
    """
    links = g.table("chains")
    longest = links.agg(F.max("n")).first()[0] or 0
    facts = lambda rows: rows.select(F.col("s").alias("_at"), F.col("p").alias("link"), F.col("o").alias("_to"))
    at_link = lambda rows, k: facts(rows).join(links.where(f"at = {k}").select("link"), "link", "left_semi")  # noqa: E731  other facts need not move
    out = []
    for turn in range(1 if new is None else longest):
        of = [new if new is not None and k == turn else rel for k in range(longest)]
        path = facts(of[0]).withColumnRenamed("_at", "s").join(links.where(f"at = 0 and n > {turn}"), "link").select("id", "target", "n", "s", F.col("_to").alias("_at"))
        for k in range(1, longest):
            out.append(path.where(f"n = {k}"))
            path = path.where(f"n > {k}").join(links.where(f"at = {k}").select("id", "link"), "id").join(at_link(of[k], k), ["_at", "link"]).select("id", "target", "n", "s", F.col("_to").alias("_at"))
        out.append(path)
    return union([p.select("s", F.col("target").alias("p"), F.col("_at").alias("o")) for p in out], REL).distinct() if out and longest else rel.select(*REL).limit(0)


def reflexive(g: Graph, individuals: DataFrame) -> DataFrame:
    """RSN-19: every individual (s) relates to itself by each reflexive property."""
    return g.reflexives(individuals).select("s", "p", F.col("s").alias("o"))


# -- types -------------------------------------------------------------------------------------------------------------


def _super_rows(g: Graph, typ: DataFrame) -> DataFrame:
    return typ.join(g.table("class_closed"), "c").select("s", F.col("d").alias("c"))


def subclass(g: Graph, typ: DataFrame) -> DataFrame:
    """RSN-1/2: named and anonymous super classes, equivalences both ways, closed on the driver."""
    return _super_rows(g, typ).distinct()


def _domain_rows(g: Graph, rel: DataFrame) -> DataFrame:
    return rel.join(g.table("domain"), "p").select("s", "c")


def _range_rows(g: Graph, rel: DataFrame) -> DataFrame:
    return rel.join(g.table("range"), "p").select(F.col("o").alias("s"), "c")


def domain(g: Graph, rel: DataFrame) -> DataFrame:
    return _domain_rows(g, rel).distinct()


def range_(g: Graph, rel: DataFrame) -> DataFrame:
    return _range_rows(g, rel).distinct()


def union_of(g: Graph, typ: DataFrame) -> DataFrame:
    """RSN-13: a member of any operand is a member of the union."""
    return typ.join(g.table("or"), "c").select("s", F.col("x").alias("c")).distinct()


def intersection_of(g: Graph, typ: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """RSN-12: a member of all operands is a member of the intersection, and the other way round.

    With ``fresh`` (a part of ``typ``) only what its rows may change: subjects with a new operand, members of a new intersection.
    """
    t, new = g.table("and"), typ if fresh is None else fresh
    member = typ.join(t, "c")
    member = member if fresh is None else member.join(fresh.join(t.select("c"), "c", "left_semi").select("s"), "s", "left_semi")
    up = member.groupBy("s", "x", "n").agg(F.size(F.collect_set("c")).alias("k")).where("k = n").select("s", F.col("x").alias("c"))
    down = new.join(t.select("x", F.col("c").alias("d")), F.col("c") == F.col("x")).select("s", F.col("d").alias("c"))
    return up.unionByName(down).distinct()


def _fillers(typ: DataFrame, table: DataFrame) -> DataFrame:
    """(o, f): members of the fillers that a table names; other types need not move for its join."""
    return typ.select(F.col("s").alias("o"), F.col("c").alias("f")).join(table.select("f"), "f", "left_semi")


def some_values(g: Graph, typ: DataFrame, rel: DataFrame) -> DataFrame:
    """RSN-14: x P y and y in F put x into (some P F); a filler Thing needs no type."""
    t = rel.join(g.table("some"), "p")
    typed = t.where(F.col("f") != THING).join(_fillers(typ, g.table("some")), ["o", "f"])
    return typed.select("s", F.col("x").alias("c")).unionByName(t.where(F.col("f") == THING).select("s", F.col("x").alias("c"))).distinct()


def all_values(g: Graph, typ: DataFrame, rel: DataFrame) -> DataFrame:
    """RSN-15: x in (all P F) and x P y put y into F."""
    values = rel.join(g.table("all").select("p"), "p", "left_semi")
    return typ.join(g.table("all"), F.col("c") == F.col("x")).select("s", "p", "f").join(values, ["s", "p"]).select(F.col("o").alias("s"), F.col("f").alias("c")).distinct()


def has_self(g: Graph, rel: DataFrame) -> DataFrame:
    """RSN-16: x P x puts x into (self P)."""
    return rel.where("s = o").join(g.table("self"), "p").select("s", F.col("x").alias("c")).distinct()


def has_value(g: Graph, rel: DataFrame) -> DataFrame:
    """x P v puts x into (value P v)."""
    return rel.join(g.table("value"), ["p", "o"]).select("s", F.col("x").alias("c")).distinct()


def value_facts(g: Graph, typ: DataFrame) -> DataFrame:
    """x in (value P v) gives x P v."""
    return typ.join(g.table("value"), F.col("c") == F.col("x")).select("s", "p", "o").distinct()


# -- equality ----------------------------------------------------------------------------------------------------------


def functional_same(g: Graph, rel: DataFrame) -> DataFrame:
    """RSN-10: pairs (a, b), a < b, forced equal by functional and inverse functional properties.

    Each value is paired with the smallest of its group, so a group of n gives n-1 pairs, not n squared.
    """
    f = g.having(rel, "functional").select("p", F.col("s").alias("k"), F.col("o").alias("v"))
    i = g.having(rel, "inverse_functional").select("p", F.col("o").alias("k"), F.col("s").alias("v"))
    return _to_least(f.unionByName(i), ["p", "k"])


def _to_least(rows: DataFrame, by: list[str]) -> DataFrame:
    low = rows.groupBy(*by).agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a <> z").drop("z")
    return rows.join(low, by).where("v <> a").select("a", F.col("v").alias("b")).distinct()


def max_one_same(g: Graph, typ: DataFrame, rel: DataFrame) -> DataFrame:
    """RSN-17: values of P of type F are equal for members of (max or exactly 1 P F); larger bounds derive nothing in RL."""
    t = typ.join(g.table("max_one"), F.col("c") == F.col("x")).select("s", "p", "f", "x")
    v = t.join(rel, ["s", "p"])
    typed = v.where(F.col("f") != THING).join(typ.select(F.col("s").alias("o"), F.col("c").alias("f")), ["o", "f"])
    every = typed.select("x", "s", F.col("o").alias("v")).unionByName(v.where(F.col("f") == THING).select("x", "s", F.col("o").alias("v")))
    return _to_least(every, ["x", "s"])


def key_same(g: Graph, typ: DataFrame, rel: DataFrame) -> DataFrame:
    """RSN-18: members of a class that agree on all properties of one of its keys are equal."""
    keys = g.table("keys")
    longest = keys.agg(F.max("n")).first()[0] or 0
    rows = typ.join(keys.where("at = 0").select("id", "c", "n"), "c").select("id", "n", "s", F.array().cast("array<string>").alias("k"))
    out = []
    for at in range(longest):
        step = rows.where(f"n > {at}").join(keys.where(f"at = {at}").select("id", "p"), "id").join(rel.select("s", "p", "o"), ["s", "p"])
        rows = step.select("id", "n", "s", F.concat("k", F.array("o")).alias("k"))
        out.append(rows.where(f"n = {at + 1}").select("id", "k", F.col("s").alias("v")))
    return _to_least(union(out, ["id", "k", "v"]), ["id", "k"]) if out else typ.select(F.col("s").alias("a"), F.col("c").alias("b")).limit(0)


def representatives(pairs: DataFrame) -> DataFrame:
    """(s, r): every individual of an equality and the smallest one equal to it, by rounds of minima over edges."""
    edges = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settle(edges.select(F.col("a").alias("s")).distinct().select("s", F.col("s").alias("r")))
    for _ in rounds("equalities"):
        low = edges.join(label, F.col("b") == F.col("s")).groupBy("a").agg(F.min("r").alias("m"))
        new = settle(label.join(low, F.col("s") == F.col("a")).select("s", F.least("r", "m").alias("r")))
        # Pointers double: a label's own label is never larger.
        new = settle(new.alias("x").join(new.alias("y"), F.col("x.r") == F.col("y.s")).select(F.col("x.s").alias("s"), F.col("y.r").alias("r")))
        if new.join(label, ["s", "r"], "left_anti").isEmpty():
            return new
        label = new


def substitute_same(rows: DataFrame, reps: DataFrame, columns: list[str]) -> DataFrame:
    """RSN-11: individuals by their representatives; reps joins by key, so a hub costs no pairs."""
    for c in columns:
        rows = rows.join(reps.select(F.col("s").alias("_s"), F.col("r").alias("_r")), F.col(c) == F.col("_s"), "left").withColumn(c, F.coalesce("_r", c)).drop("_s", "_r")
    return rows.distinct()


def expand_same(rows: DataFrame, reps: DataFrame, columns: list[str]) -> DataFrame:
    """RSN-11, the way back: a fact of a representative holds for every individual equal to it.

    ``rows`` has each fact of representatives once; sets of equals share no member, so nothing comes twice here.  A row may
    become many, so the few rows are dealt to all tasks first: by their size they would be merged into few partitions.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for c in columns:
        rows = rows.join(reps.select(F.col("s").alias("_s"), F.col("r").alias("_r")), F.col(c) == F.col("_r"), "left").withColumn(c, F.coalesce("_s", c)).drop("_s", "_r")
    return rows


# -- existentials ------------------------------------------------------------------------------------------------------


def _pairs(table: DataFrame) -> DataFrame:
    """(p, f) of a schema table, each once and broadcast as far as the table is."""
    return table.groupBy("p", "f").agg(F.lit(1).alias("_n")).select("p", "f")


def skolems(g: Graph, typ: DataFrame, rel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RSN-21: for C below (some P F), members of C without a named P value in F get one made-up witness, to depth one."""
    t = g.table("witnessed")
    need = typ.where(~F.col("s").startswith("_:")).join(t, "c").select("s", "x", "p", "f").distinct()
    # Only values of the properties and types of the fillers that are asked for are looked at, a property with its own fillers.
    has = rel.join(_pairs(t), "p").select("s", "p", "o", "f").join(_fillers(typ, t), ["o", "f"]).select("s", "p", "f")
    lack = need.join(has, ["s", "p", "f"], "left_anti").withColumn("o", F.concat(F.lit("_:"), "s", F.lit("|"), "x"))
    return lack.select("s", "p", "o"), lack.select(F.col("o").alias("s"), F.col("f").alias("c"))


# -- the whole ---------------------------------------------------------------------------------------------------------


def materialize(g: Graph, existentials: bool = False, equality: bool = False) -> Graph:
    """All entailed types and relations (RSN-0 .. RSN-19); anonymous classes stay in ``types`` by their ids.

    With ``equality`` equal individuals share all facts: facts are derived for the smallest of each set of equals, new
    equalities are sought among what was derived until there are none, and the result is expanded to all of them; its
    ``same`` has (a, b) for each individual a and its smallest equal b.
    """
    base_rel, base_typ = g.relations.select(*REL), g.types.select(*TYP)
    if existentials:
        first = materialize(g, existentials=False, equality=equality)
        more_rel, more_typ = skolems(g, first.types, first.relations)
        base_rel, base_typ = base_rel.unionByName(settle(more_rel)), base_typ.unionByName(settle(more_typ))
    out = _saturated(replace(g, types=base_typ, relations=base_rel))
    if not equality:
        return out
    pairs = [] if g.same is None else [g.same.select("a", "b")]
    reps = None
    for _ in rounds("equalities"):
        found = union([*pairs, functional_same(g, out.relations), max_one_same(g, out.types, out.relations), key_same(g, out.types, out.relations)], ["a", "b"]).where("a <> b")
        found = settle(found.distinct())
        if found.isEmpty():
            break
        # Former equals stay equal: their pairs with their representatives join the new ones.
        earlier = [] if reps is None else [reps.select(F.col("s").alias("a"), F.col("r").alias("b"))]
        reps = representatives(union([found, *earlier], ["a", "b"]))
        pairs = []
        out = _saturated(replace(g, types=substitute_same(base_typ, reps, ["s"]), relations=substitute_same(base_rel, reps, ["s", "o"])))
    if reps is None:
        return out
    same = reps.select(F.col("s").alias("a"), F.col("r").alias("b"))
    # The expansion of n equals has n rows for each fact of theirs: it is made where it is read, never written here.
    # Objects come first: many facts have equal subjects, and what the last join makes is not moved even where it is no broadcast.
    return replace(out, types=expand_same(out.types.select(*TYP), reps, ["s"]), relations=expand_same(out.relations.select(*REL), reps, ["o", "s"]), same=same)


def _saturated(g: Graph) -> Graph:
    """Entailments without equality.  Facts by ``value`` expressions may feed new relations; then all starts from these, too."""
    out = _derived(g)
    for _ in rounds("value restrictions"):
        if not g.has("value"):
            return out
        more = settle(value_facts(g, out.types).join(out.relations, list(REL), "left_anti"))
        if more.isEmpty():
            return out
        g = replace(g, relations=g.relations.select(*REL).unionByName(more))
        out = _derived(g)


def _derived(g: Graph) -> Graph:
    """Relations first, then types, each by semi-naive rounds.

    A round joins only the last round's new rows with what is known, drops known rows by anti-join and settles the
    result in the shared folder, so that lineage stays short and a lost executor repeats one round at most.
    """
    base_rel, base_typ = g.relations.select(*REL), g.types.select(*TYP)
    # Properties of no chain, step or transitive axiom derive no relation: their facts are read once and not iterated.
    moving, still = g.moving(base_rel)
    known = settle(moving.unionByName(apply_property_steps(g, moving)).distinct())
    new = known
    for k in rounds("relations"):
        made = [transitive_step(g, new, known)] if g.has("transitive") else []
        if g.has("chains"):
            made.append(chain(g, known, new if k else None))
        if not made:
            break
        made = union(made, REL)
        made = made.unionByName(apply_property_steps(g, made))
        new = settle(made.distinct().join(known.join(g.derived_properties(), "p", "left_semi"), list(REL), "left_anti"))
        if new.isEmpty():
            break
        known = _grown(known, new, k)
    rel = still.distinct().unionByName(known)
    if g.has("reflexive"):
        people = base_typ.select("s").unionByName(rel.select("s")).unionByName(rel.select(F.col("o").alias("s"))).distinct()
        rel = rel.unionByName(reflexive(g, people)).distinct()
    parts = [base_typ]
    parts += [_domain_rows(g, rel)] if g.has("domain") else []
    parts += [_range_rows(g, rel)] if g.has("range") else []
    typ = union(parts, TYP)
    supers = g.has("class_closed")
    if supers:
        typ = typ.unionByName(_super_rows(g, typ))
    typ = settle(typ.distinct())
    near = settle(g.used(rel)) if g.has("some", "all", "self", "value") else rel  # relations are complete here, only these matter to expressions
    fresh = typ
    for turn in rounds("types"):
        made = []
        if g.has("or"):
            made.append(union_of(g, fresh))
        if g.has("and"):
            made.append(intersection_of(g, typ, fresh if turn else None))
        if g.has("some"):
            made.append(some_values(g, fresh, near))
        if g.has("all"):
            made.append(all_values(g, fresh, near))
        if turn == 0:
            made += [has_self(g, near)] if g.has("self") else []
            made += [has_value(g, near)] if g.has("value") else []
        if not made:
            break
        made = union(made, TYP)
        made = made.unionByName(_super_rows(g, made)) if supers else made
        fresh = settle(made.distinct().join(typ.join(g.derived_classes(), "c", "left_semi"), list(TYP), "left_anti"))
        if fresh.isEmpty():
            break
        typ = _grown(typ, fresh, turn)
    return replace(g, types=typ, relations=rel)


def named_types(g: Graph, typ: DataFrame) -> DataFrame:
    """Types without anonymous classes and Thing (FLT-4, FLT-5)."""
    return typ.where(~g.anonymous(F.col("c")) & (F.col("c") != THING))


def named_relations(rel: DataFrame) -> DataFrame:
    """Relations between named individuals: made-up witnesses go (RSN-21)."""
    return rel.where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:"))


def is_entailed(typ: DataFrame, rel: DataFrame, facts: DataFrame) -> DataFrame:
    """RSN-23: the facts (s, p, o) that hold; p = rdf:type asks for a type."""
    t = facts.where("p = 'rdf:type'").join(typ.select("s", F.col("c").alias("o")), ["s", "o"], "left_semi")
    return t.select(*REL).unionByName(facts.where("p <> 'rdf:type'").join(rel, list(REL), "left_semi").select(*REL))


# -- clashes -----------------------------------------------------------------------------------------------------------


def clashes(g: Graph, typ: DataFrame, rel: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """RSN-20: (rule, a, b) of every contradiction found; an empty result means that no clash rule fires.

    same has (a, b) for an individual and its smallest equal (``materialize`` gives it); individuals that an axiom of
    ``g.different`` or of the schema tells apart must not share one.  A group of n is never written as its pairs.
    """
    out = []
    if g.has("disjoint"):
        # Two places are seen by their minimum and maximum; only members that have both are gathered.
        placed = typ.select("s", "c").join(g.table("disjoint"), "c")
        both = placed.groupBy("axiom", "s").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo <> hi").select("axiom", "s")
        met = placed.join(both, ["axiom", "s"], "left_semi").groupBy("axiom", "s").agg(F.array_sort(F.collect_set(F.struct("at", "c"))).alias("m"))
        out.append(met.select(F.lit("disjoint_classes").alias("rule"), F.col("s").alias("a"), F.array_join(F.transform("m", lambda x: x["c"]), "|").alias("b")))
    if g.has("disjoint_property"):
        out.append(rel.join(g.table("disjoint_property"), "p").join(rel.select("s", F.col("p").alias("q"), "o"), ["s", "q", "o"]).select(F.lit("disjoint_properties").alias("rule"), F.col("s").alias("a"), F.col("o").alias("b")))
    if g.has("irreflexive"):
        out.append(g.having(rel.where("s = o"), "irreflexive").select(F.lit("irreflexive").alias("rule"), F.col("s").alias("a"), F.col("p").alias("b")))
    if g.has("asymmetric"):
        a = g.having(rel, "asymmetric")
        out.append(a.join(a.select(F.col("o").alias("s"), "p", F.col("s").alias("o")), list(REL)).select(F.lit("asymmetric").alias("rule"), F.col("s").alias("a"), F.col("o").alias("b")))
    apart = apart_groups(g)
    if same is not None and apart is not None:
        placed = apart.join(same.select(F.col("a").alias("s"), F.col("b").alias("r")), "s", "left").withColumn("r", F.coalesce("r", "s"))
        met = placed.groupBy("axiom", "r").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b")
        out.append(met.select(F.lit("same_and_different").alias("rule"), "a", "b"))
    return union(out, ["rule", "a", "b"]).distinct() if out else typ.select(F.lit("").alias("rule"), F.col("s").alias("a"), F.col("c").alias("b")).limit(0)


def apart_groups(g: Graph) -> DataFrame | None:
    """(axiom, s) of individuals told apart, by asserted pairs and by the schema's groups; None if there are none."""
    parts = [] if g.different is None else [g.different.select("axiom", "s")]
    parts += [g.table("different")] if g.has("different") else []
    return union(parts, ["axiom", "s"]).distinct() if parts else None


def is_consistent(g: Graph, typ: DataFrame, rel: DataFrame, same: DataFrame | None = None) -> bool:
    """Whether no clash rule fires."""
    return clashes(g, typ, rel, same).isEmpty()


def keep_consistent(rows: DataFrame, found: DataFrame, graph: str = "graph_id") -> DataFrame:
    """FLT-15: rows of the graphs in which no clash was found; ``found`` has the graph of every clash."""
    return rows.join(found.select(graph).distinct(), graph, "left_anti")


def tbox_closure(schema: Schema) -> list[tuple[str, str]]:
    """RSN-22: the named class hierarchy, closed."""
    return sorted((a, b) for a, b in closed(schema.class_edges()) if a != b and schema.named(a) and schema.named(b))

