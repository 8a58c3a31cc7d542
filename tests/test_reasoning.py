"""Rules, fixpoint, clashes and explanations on small graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import explain as X
from quillon.operators import reasoning as R
from quillon.operators import tags as T
from quillon.operators.model import Expression, Graph, Schema, chain_paths, closed


def graph(spark, types=(), relations=(), **schema):
    return Graph(spark.createDataFrame(list(types), "s string, c string"), spark.createDataFrame(list(relations), "s string, p string, o string"), Schema(**schema))


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_closed_ends_on_cycles():
    assert closed({("a", "b"), ("b", "a")}) == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}
    assert ("p", "q", False) in closed({("p", "r", True), ("r", "q", True)})


def test_chain_paths_are_short_and_cycle_free():
    paths = chain_paths({("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")}, 3)
    assert ["a", "b", "c"] in [p for _, _, p in paths] and all(len(set(p)) == len(p) <= 3 for _, _, p in paths)


def test_family_with_existential(spark):
    g = graph(
        spark, [("ann", "Person"), ("bob", "Person"), ("cy", "Person")], [("ann", "hasParent", "bob"), ("cy", "hasFather", "bob")],
        subclass=[("Person", "_f")], subproperty=[("hasFather", "hasParent")], inverse=[("hasParent", "isParentOf")], chains=[(("hasParent", "isParentOf"), "isSiblingOf")],
        symmetric=["isSiblingOf"], transitive=["isSiblingOf"], expressions={"_f": Expression("some", prop="hasFather", filler="Man")},
    )
    m = R.materialize(g, existentials=True)
    rel = rows(R.named_relations(m.relations.select("s", "p", "o")))
    assert {("ann", "isSiblingOf", "cy"), ("cy", "isSiblingOf", "ann"), ("bob", "isSiblingOf", "bob"), ("bob", "isParentOf", "cy")} <= rel
    again = R.materialize(Graph(m.types.select("s", "c"), m.relations.select("s", "p", "o"), g.schema))
    assert rows(again.relations.select("s", "p", "o")) == rows(m.relations.select("s", "p", "o"))  # idempotent


def test_cyclic_transitive_and_symmetric(spark):
    g = graph(spark, relations=[("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a")], transitive=["p"], symmetric=["p"], subproperty=[("p", "q"), ("q", "p")])
    assert len(rows(R.materialize(g).relations.where("p = 'p'"))) == 9


def test_class_expressions(spark):
    g = graph(
        spark, [("a", "A"), ("a", "B"), ("b", "B"), ("c", "OnlyD")], [("a", "r", "b"), ("c", "r", "d"), ("a", "self", "a")],
        equivalent=[("Both", "_and"), ("Some", "_some"), ("Any", "_or"), ("OnlyD", "_all"), ("Self", "_self")],
        expressions={"_and": Expression("and", ("A", "B")), "_or": Expression("or", ("A", "B")), "_some": Expression("some", prop="r", filler="B"), "_all": Expression("all", prop="r", filler="D"), "_self": Expression("self", prop="self")},
    )
    got = rows(R.named_types(g, R.materialize(g).types).select("s", "c"))
    assert {("a", "Both"), ("a", "Some"), ("a", "Any"), ("b", "Any"), ("d", "D"), ("a", "Self")} <= got and ("b", "Both") not in got


def test_equal_individuals_keep_all_facts(spark):
    g = graph(spark, [("x", "C"), ("k1", "K"), ("k2", "K"), ("k2", "L")], [("a", "f", "x"), ("a", "f", "y"), ("y", "q", "z"), ("k1", "id", "7"), ("k2", "id", "7")], functional=["f"], keys=[("K", ("id",))])
    m = R.materialize(g, equality=True)
    assert rows(m.relations.select("s", "p", "o")) == {("a", "f", "x"), ("a", "f", "y"), ("y", "q", "z"), ("x", "q", "z"), ("k1", "id", "7"), ("k2", "id", "7")}
    assert rows(m.types.select("s", "c")) == {("x", "C"), ("y", "C"), ("k1", "K"), ("k2", "K"), ("k1", "L"), ("k2", "L")}
    assert rows(m.same) == {("x", "x"), ("y", "x"), ("k1", "k1"), ("k2", "k1")}


def test_equalities_lead_to_further_ones(spark):
    """x = y joins the values of g, so u = v; these join the values of h, so 1 = 2; an asserted equality counts, too."""
    g = graph(spark, relations=[("a", "f", "x"), ("a", "f", "y"), ("x", "g", "u"), ("y", "g", "v"), ("u", "h", "1"), ("v", "h", "2"), ("w", "p", "b")], functional=["f", "g", "h"])
    g.same = spark.createDataFrame([("w", "u")], "a string, b string")
    m = R.materialize(g, equality=True)
    assert {("1", "1"), ("2", "1"), ("w", "u"), ("v", "u")} <= rows(m.same)
    assert {("v", "p", "b"), ("w", "h", "2"), ("x", "g", "w")} <= rows(m.relations.select("s", "p", "o"))


def test_long_chains_through_some(spark):
    n = 60
    g = graph(spark, [("i0", "A")], [(f"i{k + 1}", "p", f"i{k}") for k in range(n)], subclass=[("_s", "A")], expressions={"_s": Expression("some", prop="p", filler="A")})
    m = R.materialize(g)
    assert {s for s, c in rows(m.types.select("s", "c")) if c == "A"} == {f"i{k}" for k in range(n + 1)}


def test_chain_of_three_is_semi_naive(spark):
    facts = [("a", "p", "b"), ("b", "q", "c"), ("c", "r", "d"), ("d", "p", "e"), ("e", "q", "f"), ("f", "r", "g")]
    g = graph(spark, relations=facts, chains=[(("p", "q", "r"), "t"), (("t", "t"), "t")])
    assert {(s, o) for s, p, o in rows(R.materialize(g).relations.select("s", "p", "o")) if p == "t"} == {("a", "d"), ("d", "g"), ("a", "g")}
    new = spark.createDataFrame([("e", "q", "f")], "s string, p string, o string")
    assert ("d", "t", "g") in rows(R.chain(g, g.relations, new)) and ("a", "t", "d") not in rows(R.chain(g, g.relations, new))


def test_a_fixpoint_never_stops_silently(spark, monkeypatch):
    monkeypatch.setattr(R, "GUARD", 3)
    g = graph(spark, [("i0", "A")], [(f"i{k + 1}", "p", f"i{k}") for k in range(9)], subclass=[("_s", "A")], expressions={"_s": Expression("some", prop="p", filler="A")})
    with pytest.raises(RuntimeError):
        R.materialize(g)


def test_value_restrictions(spark):
    g = graph(spark, [("x", "Red")], [("y", "colour", "red"), ("z", "colour", "blue")], equivalent=[("Red", "_v")], subproperty=[("colour", "look")], expressions={"_v": Expression("value", prop="colour", filler="red")})
    m = R.materialize(g)
    assert {("x", "colour", "red"), ("x", "look", "red")} <= rows(m.relations.select("s", "p", "o")) and ("y", "Red") in rows(m.types.select("s", "c")) and ("z", "Red") not in rows(m.types.select("s", "c"))


def test_max_one(spark):
    g = graph(spark, [("a", "One")], [("a", "r", "y"), ("a", "r", "x")], equivalent=[("One", "_m")], expressions={"_m": Expression("max", prop="r", n=1)})
    assert rows(R.max_one_same(g, R.materialize(g).types, g.relations)) == {("x", "y")}


def test_clashes(spark):
    g = graph(spark, [("a", "A"), ("a", "B")], [("a", "p", "a"), ("a", "q", "b"), ("b", "q", "a"), ("a", "r", "b")], disjoint=[("A", "B")], irreflexive=["p"], asymmetric=["q"], disjoint_property=[("q", "r")])
    assert {r[0] for r in rows(R.clashes(g, g.types, g.relations))} == {"disjoint_classes", "irreflexive", "asymmetric", "disjoint_properties"}


def test_same_and_different_clash(spark):
    g = graph(spark, relations=[("a", "f", "x"), ("a", "f", "y")], functional=["f"], all_different=[("d", "x"), ("d", "z"), ("d", "y")])
    m = R.materialize(g, equality=True)
    assert rows(R.clashes(m, m.types, m.relations, m.same)) == {("same_and_different", "x", "y")} and not R.is_consistent(m, m.types, m.relations, m.same)
    assert rows(R.keep_consistent(spark.createDataFrame([("g1", 1), ("g2", 2)], "graph_id string, v int"), spark.createDataFrame([("g1",)], "graph_id string"))) == {("g2", 2)}


def test_reach_over_equal_and_different(spark):
    from quillon.operators import hops as H

    g = graph(spark, relations=[("a", "p", "b")], all_different=[("d", x) for x in "bcde"])
    g.same = spark.createDataFrame([("e", "f")], "a string, b string")
    start = spark.createDataFrame([("a",)], "x string")
    assert {y for _, y in rows(H.reach(g, start, 2))} == {*"abcde"} and {y for _, y in rows(H.reach(g, start, 3))} == {*"abcdef"}
    modules = H.with_schema(graph(spark, symmetric=["p"], subclass=[("A", "B")]), spark.createDataFrame([("a", "p|a|b"), ("b", "p|a|b")], "x string, axiom string"))
    assert rows(modules) == {(x, y) for x in "ab" for y in ("p|a|b", "Symmetric|p", "SubClassOf|A|B")}


def test_hops(spark):
    from quillon.operators import hops as H

    g = graph(spark, [("a", "A")], [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d")])
    one = rows(H.hop(g, 1, F.col("x") == "a"))
    assert one == {("a", "p|a|b"), ("a", "rdf:type|a|A")}
    assert ("a", "p|b|c") in rows(H.hop(g, 2, F.col("x") == "a")) and ("a", "p|c|d") not in rows(H.hop(g, 2, F.col("x") == "a"))
    start = spark.createDataFrame([("a",)], "x string")
    assert {y for _, y in rows(H.reach(g, start, 2))} == {"a", "b", "c"}
    assert ("a", "p|c|d") not in rows(H.module(g, 2, start)) and ("a", "p|c|d") in rows(H.module(g, 3, start))


TAGS = [
    ("PropertyAssertion p x y;InverseProperties p q", "x p y;q owl:inverseOf p", "DII"), ("PropertyAssertion p x y;SymmetricProperty p", "x p y;SymmetricObjectProperty(p)", "DSS"),
    ("PropertyAssertion q x y;SubPropertyOf q p", "x q y;q rdfs:subPropertyOf p", "DHH"), ("PropertyAssertion p x y", "x p y", "D"), ("ClassAssertion C x;SubClassOf C D", "x rdf:type C;C rdfs:subClassOf D", "DH"),
    ("Domain p C;PropertyAssertion p x y;SubPropertyOf q p", "x p y;domain(p) = C", "DHRM"), ("", "", "M"), ("", "asymmetric", "S"), ("", "irreflexive", "V"), ("", "inverseFunctional", "I"), ("", "P Domain C", "M"), ("", "is a thing", "D"),
]


@pytest.mark.parametrize(("axioms", "said", "want"), TAGS)
def test_tags(spark, axioms, said, want):
    ax = [(a.split()[0], a.split()[1:]) for a in axioms.split(";") if a]
    df = spark.createDataFrame([(ax, [j for j in said.split(";") if j])], "axioms array<struct<kind:string,args:array<string>>>, justifications array<string>")
    assert T.with_tags(df).first()["tag"] == want


def test_shared_tags_equal_own_tags(spark, monkeypatch):
    """Tags by shape and tags row by row, with names that hold words of the rules, end in a or in digits, or repeat."""
    import random

    rng = random.Random(3)
    names = ["x1", "x2", "customer/17", "inverse7", "min2", "data", "a", "9", "subclassof1", "ada 1", "domain(3", "Range"]
    rows = []
    for _ in range(400):
        ax, said = [], []
        for kind, args, text in rng.sample([("PropertyAssertion", 3, "{1} {0} {2}"), ("ClassAssertion", 2, "{1} rdf:type {0}"), ("SubClassOf", 2, "{0} SubClassOf {1}"), ("Domain", 2, "domain({0}) = {1}"), ("Expression", 2, "some {0}.{1} restriction satisfied by {0}"), ("InverseProperties", 2, "{0} owl:inverseOf {1}"), ("Expression", 1, "min {0} max {0}")], rng.randrange(4)):
            who = [rng.choice(names) for _ in range(args)]
            ax += [(kind, who)] * rng.choice([1, 1, 2]) if rng.random() < 0.8 else []
            said += [text.format(*who)] if rng.random() < 0.8 else []
        rows.append((len(rows), ax, said))
    df = spark.createDataFrame(rows, "k int, axioms array<struct<kind:string,args:array<string>>>, justifications array<string>")
    want = {r["k"]: r["tag"] for r in T.with_tags(df).collect()}
    shared = T.with_shared_tags(df)
    assert {r["k"]: r["tag"] for r in shared.collect()} == want and shared.columns == ["k", "axioms", "justifications", "tag"]
    assert df.select(T.shape(F.col("axioms"), F.col("justifications"))).distinct().count() < 390
    monkeypatch.setattr(T, "SHAPES", 0)
    assert {r["k"]: r["tag"] for r in T.with_shared_tags(df).collect()} == want


def test_dedup_is_stable(spark):
    g = graph(spark, [("a", "A")], [("a", "p", "b"), ("a", "p", "c")], domain=[("p", "A")])
    f = X.Facts(g, g.types, g.relations, g.types, g.relations)
    paths = X.explain_all(f, ["EXP-3", "EXP-19", "EXP-28"])
    one, two = X.deduplicate(paths), X.deduplicate(paths.repartition(3, "strategy").orderBy(F.desc("strategy")))
    assert rows(one.select("s", "o", "description")) == rows(two.select("s", "o", "description")) and one.count() == 2


def _facts(spark, types, relations, schema):
    t, r = spark.createDataFrame(types, "s string, c string"), spark.createDataFrame(relations, "s string, p string, o string")
    return X.Facts(Graph(t, r, schema), t, r, t.distinct(), r.distinct())


def test_domain_trace_takes_the_smallest_whole_text(spark):
    """A value that begins like another one is followed by a separator, which sorts after digits."""
    f = _facts(spark, [("s", "D")], [("s", "p", "a1"), ("s", "p", "a10")], Schema(domain=[("p", "D")]))
    assert [r["justifications"][0] for r in X.explain(f, "EXP-6").collect()] == ["s p a10"]


def test_many_strategies_are_not_one_plan(spark):
    schema = Schema(subclass=[("C", "D")], domain=[("p", "D")], range=[("p", "C")], inverse=[("p", "q")])
    f = _facts(spark, [("a", "C"), ("a", "C"), ("a", "D"), ("b", "C")], [("a", "p", "b"), ("a", "p", "b"), ("b", "q", "a")], schema)
    names = ["EXP-1", "EXP-3", "EXP-4", "EXP-9", "EXP-12", "EXP-28", "EXP-30", "EXP-34"]
    every = X.explain_all(f, names)
    assert every._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    line = lambda df: [repr(tuple(r)) for r in df.select("s", "p", "o", "strategy", "axioms", "justifications").collect()]
    one_by_one = [r for n in names for r in line(X.explain(f, n))]
    assert sorted(line(every)) == sorted(one_by_one) and len(set(one_by_one)) == len(one_by_one)


def test_equals_are_expanded_where_they_are_read(spark):
    rel = spark.createDataFrame([("n", "has", "a"), ("n", "has", "b"), ("a", "sells", "x"), ("b", "sells", "x"), ("b", "sells", "y")], "s string, p string, o string")
    m = R.materialize(Graph(spark.createDataFrame([("a", "S")], "s string, c string"), rel, Schema(functional=["has"])), equality=True)
    assert not hasattr(m.relations, "_settled_at") and not hasattr(m.types, "_settled_at")
    assert sorted(map(tuple, m.relations.collect())) == [("a", "sells", "x"), ("a", "sells", "y"), ("b", "sells", "x"), ("b", "sells", "y"), ("n", "has", "a"), ("n", "has", "b")]
    assert sorted(map(tuple, m.types.collect())) == [("a", "S"), ("b", "S")]


def test_witnesses_look_at_asked_fillers_alone(spark):
    schema = Schema(subclass=[("C", "_s"), ("E", "_t")], expressions={"_s": Expression("some", prop="p", filler="F"), "_t": Expression("some", prop="q", filler="G")})
    f = _facts(spark, [("a", "C"), ("b", "C"), ("e", "E"), ("f", "F"), ("g", "G")], [("a", "p", "f"), ("b", "p", "g"), ("e", "p", "g"), ("e", "q", "f")], schema)
    got = R.skolems(f.g, f.typ, f.rel)[0]
    assert sorted(map(tuple, got.collect())) == [("b", "p", "_:b|_s"), ("e", "q", "_:e|_t")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 1  # types of no filler are left out before the join


def test_targets_are_checked_before_texts_are_written(spark):
    f = _facts(spark, [("a", "C"), ("a", "D")], [("a", "p", "b"), ("b", "q", "c"), ("a", "r", "c")], Schema(subclass=[("C", "D")], chains=[(("p", "q"), "r")]))
    for n in ("EXP-9", "EXP-10", "EXP-35"):
        paths = X.explain(f, n)
        plan = paths._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("justifications") < plan.index("LeftSemi") and paths.count() == 1


@pytest.mark.parametrize("marked", ["", "\x03"])
def test_paths_by_shape_equal_paths_with_texts(spark, marked):
    """Tags and texts by shape are those of whole paths, with names that repeat, hold rule words, end in letters or hold a mark."""
    from quillon.operators import brief as B

    schema = Schema(subclass=[("C", "D"), ("D", "E1"), ("E1", "_all")], domain=[("p", "D"), ("r", "E1"), ("s", "D")], range=[("p", "C")], inverse=[("p", "q")], symmetric=["s"], transitive=["t"], chains=[(("t", "t"), "r"), (("p", "q"), "r")], equivalent=[("C", "F"), ("G", "_and")], expressions={"_all": Expression("all", prop="p", filler="C"), "_and": Expression("and", ("C", "D"))})
    who = ["a1", "a2", "inverse7", "ada", "x/12", "min 3", f"b{marked}4"]
    edges = [(x, p, y) for k, x in enumerate(who) for p in "pqrst" for y in (who[k - 1], who[k - 3], x)]
    f = _facts(spark, [(x, c) for x in who for c in ("C", "D", "E1", "F", "G")], edges, schema)
    names = [n for n in (X.CLASS_STRATEGIES | X.RELATION_STRATEGIES)]
    whole = T.with_tags(X.explain_all(f, names)).select("s", "p", "o", F.array_join("justifications", "; ").alias("justification"), "tag").cache()
    short = B.tagged(f, names)
    line = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert line(short.rows().select(*whole.columns)) == line(whole) and (short.shapes is None) == bool(marked)
    assert line(short.lengths()) == line(T.tag_lengths(whole, "s", "p", "o"))
    assert line(short.shortest()) == line(T.shortest_tag(whole, ["s", "p", "o"], "justification"))
    if not marked:  # what is written holds no texts, and names that say nothing share their shapes
        assert all(t.columns == ["s", "p", "o", "_shape", "_names"] for _, t in short.tables)
        assert short.shapes.where("_shape rlike 'a1|x/12'").count() == 0


def test_sizes_of_many_strategies(spark):
    f = _facts(spark, [("a", "C"), ("a", "C"), ("a", "D"), ("b", "C")], [("a", "p", "b"), ("a", "p", "b"), ("b", "q", "a")], Schema(subclass=[("C", "D")], domain=[("p", "D")], range=[("p", "C")], inverse=[("p", "q")]))
    names = ["EXP-1", "EXP-3", "EXP-4", "EXP-9", "EXP-28", "EXP-30", "EXP-34"]
    short = X.sizes_of(f, names)
    assert rows(short.select("s", "p", "o", "min_size", "max_size", "explanation_count")) == rows(X.sizes(X.explain_all(f, names)))
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate")  # the semi-join is above: it sees a target once


def test_subjects_are_expanded_last(spark):
    """Without a broadcast the facts of equal subjects are not shuffled after they have become many."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rel = [("n", "has", x) for x in "abc"] + [(x, "sells", f"{x}{k}") for x in "abc" for k in range(3)]
        m = R.materialize(graph(spark, [("a", "S")], rel, functional=["has"]), equality=True)
        plan = m.relations._jdf.queryExecution().sparkPlan().toString()
        assert plan[plan.index("Join") :].split("[")[1].startswith("s#")
        assert rows(m.relations) == {("n", "has", x) for x in "abc"} | {(x, "sells", f"{y}{k}") for x in "abc" for y in "abc" for k in range(3)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
