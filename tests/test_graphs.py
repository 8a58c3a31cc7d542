"""Many graphs in one fixpoint against each of them alone, closures by rounds, and the two ways names used to meet."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import closure as C
from quillon.operators import explain as X
from quillon.operators import graphs as M
from quillon.operators import hops as H
from quillon.operators import reasoning as R
from quillon.operators.model import Expression, Graph, Schema, chain_paths, closed
from quillon.sources import rdf


def rows(df):
    return {tuple(r) for r in df.collect()}


SCHEMAS = {
    "one": Schema(
        subclass=[("A", "B"), ("B", "C"), ("A", "D"), ("D", "C"), ("E", "_all")], equivalent=[("F", "_and"), ("G", "C"), ("H", "_some"), ("K", "_mix")], subproperty=[("p", "q"), ("q", "r")], inverse=[("p", "ip")], domain=[("q", "A"), ("t", "H"), ("ip", "H")],
        range=[("q", "B"), ("s", "A")], symmetric=["s"], transitive=["t"], functional=["q"], chains=[(("p", "t"), "u"), (("p", "t", "s"), "v")],
        expressions={"_and": Expression("and", ("A", "H")), "_some": Expression("some", prop="t", filler="C"), "_all": Expression("all", prop="p", filler="E"), "_mix": Expression("and", ("B", "_s2")), "_s2": Expression("some", prop="s", filler="C"), "_or": Expression("or", ("E", "F"))},
    ),
    "two": Schema(subclass=[("C", "A"), ("B", "_or")], equivalent=[("L", "_or"), ("V", "_val")], equivalent_property=[("p", "t")], transitive=["p"], reflexive=["s"], expressions={"_or": Expression("or", ("A", "E")), "_val": Expression("value", prop="s", filler="i1"), "_self": Expression("self", prop="p")}),
    "three": Schema(disjoint_groups=[("g", ("A", "B", "C"))], disjoint=[("D", "E")], irreflexive=["p"], asymmetric=["s"], disjoint_property=[("p", "q")], subproperty=[("p", "q")]),
    "four": Schema(functional=["p"], inverse_functional=["s"], keys=[("A", ("q", "t"))], expressions={"_m": Expression("max", prop="t", filler=None, n=1)}, equivalent=[("E", "_m")], all_different=[("d", "i0"), ("d", "i5")]),
}


def facts(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    who = [f"i{k}" for k in range(7)]
    return sorted({(rng.choice(who), rng.choice("ABCDE")) for _ in range(9)}), sorted({(rng.choice(who), rng.choice("pqst"), rng.choice(who)) for _ in range(12)})


@pytest.fixture(scope="module")
def both(spark):
    """Each graph alone, and all of them at once."""
    own, types, relations, axioms = {}, [], [], []
    for k, (name, s) in enumerate(SCHEMAS.items()):
        t, r = facts(k)
        own[name] = Graph(spark.createDataFrame(t, "s string, c string"), spark.createDataFrame(r, "s string, p string, o string"), s)
        types += [(name, *x) for x in t]
        relations += [(name, *x) for x in r]
        axioms += M.axiom_rows(s, name)
    every = M.many(spark.createDataFrame(types, "graph_id string, s string, c string"), spark.createDataFrame(relations, "graph_id string, s string, p string, o string"), M.axioms_frame(spark, axioms))
    return own, every


def test_each_graph_as_if_alone(spark, both):
    own, every = both
    m = R.materialize(every)
    typ, rel = M.own_names(R.named_types(every, m.types), "s"), M.own_names(m.relations.select("s", "p", "o"), "s")
    got_types, got_relations, found = rows(typ.select("graph_id", "s", "c")), rows(rel.select("graph_id", "s", "p", "o")), rows(M.clashing(R.clashes(every, m.types, m.relations)))
    alone = {}
    for name, g in own.items():
        a = alone[name] = R.materialize(g)
        assert {x[1:] for x in got_types if x[0] == name} == rows(R.named_types(g, a.types).select("s", "c")), name
        assert {x[1:] for x in got_relations if x[0] == name} == rows(a.relations.select("s", "p", "o")), name
        assert {x[1:] for x in found if x[0] == name} == rows(R.clashes(g, a.types, a.relations)), name
    assert {x[0] for x in found} == {"three"}  # the inconsistent graph leaves alone
    left = M.without(every, M.clashing(R.clashes(every, m.types, m.relations)))
    assert {r[0] for r in M.own_names(left.types, "s").select("graph_id").distinct().collect()} == set(SCHEMAS) - {"three"}
    g, a = own["one"], alone["one"]
    f = X.Facts(every, every.types, every.relations, R.named_types(every, m.types).select("s", "c"), m.relations.select("s", "p", "o"))
    columns = ["s", "p", "o", "strategy", "type", "complexity", "axioms", "justifications"]
    key = lambda df: sorted(repr(tuple(r)).replace("_:", "") for r in df.select(*columns).collect())
    want = key(X.explain_all(X.Facts(g, g.types, g.relations, R.named_types(g, a.types).select("s", "c"), a.relations.select("s", "p", "o"))))
    assert key(M.own_names(X.explain_all(f), "s").where("graph_id = 'one'")) == want and len(want) > 100


def test_equals_within_a_graph(spark, both):
    own, every = both
    m = R.materialize(every, equality=True)
    a = R.materialize(own["four"], equality=True)
    assert rows(M.own_names(m.relations.select("s", "p", "o"), "s").where("graph_id = 'four'").select("s", "p", "o")) == rows(a.relations.select("s", "p", "o"))
    assert rows(M.own_names(m.same, "a").where("graph_id = 'four'").select("a", "b")) == rows(a.same)
    assert rows(M.clashing(R.clashes(m, m.types, m.relations, m.same)).where("graph_id = 'four'").select("rule", "a", "b")) == rows(R.clashes(a, a.types, a.relations, a.same))


def test_sizes_by_graph(spark, both):
    sized = {(g, k): n for g, k, n in rows(M.graph_sizes(both[1]))}
    assert sized["three", "tbox"] == 6 and sized["four", "tbox"] == 4 and sized["four", "abox"] == sum(map(len, facts(3))) + 1
    t, r = facts(0)
    assert sized["one", "individuals"] == len({x[0] for x in t} | {x for s, _, o in r for x in (s, o)})
    total = {r["kind"]: r["n"] for r in H.totals(M.graph_sizes(both[1])).collect()}
    assert total["tbox"] == sum(n for (_, k), n in sized.items() if k == "tbox")


def test_closures_by_rounds(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (7, 12), (14, 24), (30, 33)):
        edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
        df = spark.createDataFrame(sorted(edges), "a string, b string")
        assert rows(C.closure(df)) == closed(edges) if edges else C.closure(df).isEmpty()
        turned = {(a, b, rng.random() < 0.5) for a, b in edges}
        assert rows(C.closure(spark.createDataFrame(sorted(turned), "a string, b string, swap boolean"), swap=True)) == closed(turned)
        plain = {(a, b) for a, b in edges if a != b}
        every = [(a, b, p) for a, b, p in chain_paths(plain, 6)]
        best = {}
        for a, b, p in every:
            best.setdefault((a, b), p)
        assert {(a, b): p for a, b, p in rows_of_arrays(C.shortest_chains(df.withColumn("kind", F.lit("x")), 6))} == {k: tuple(p) for k, p in best.items()}
        assert sorted(rows_of_arrays(C.all_chains(df, 6))) == sorted((a, b, tuple(p)) for a, b, p in every)
        far = {}
        for a, b, p in chain_paths(plain, n + 1) if n < 14 else []:
            far.setdefault((a, b), len(p) - 1)
        if far:
            assert {(a, b): k for a, b, k, _ in rows(C.distances(df))} == far


def rows_of_arrays(df):
    return [(r["a"], r["b"], tuple(r["nodes"])) for r in df.collect()]


def test_ranks_of_lists(spark):
    cells = [(f"x{k}", f"x{k + 1}") for k in range(20)] + [("y", "nil"), ("c1", "c2"), ("c2", "c1")]
    got = {c: (last, left) for c, last, left in rows(C.list_ranks(spark.createDataFrame(cells, "cell string, next string")))}
    assert got == {**{f"x{k}": ("x19", 20 - k) for k in range(20)}, "y": ("y", 1)}


HEAD = "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix a: <http://one.org/x#> . @prefix b: <http://two.org/x#> .\n"


def folder(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.ttl").write_text(HEAD + text)
    return str(tmp_path)


def test_names_of_two_namespaces_stay_apart(spark, tmp_path):
    at = folder(tmp_path, f="a:Bank rdfs:subClassOf a:Institution . b:Bank rdfs:subClassOf b:Terrain . a:i1 a a:Bank . b:i2 a b:Bank .")
    t = rdf.read_rdf(spark, at)
    g = M.graphs_of(t)
    got = rows(M.own_names(R.named_types(g, R.materialize(g).types), "s").select("s", "c"))
    one, two = "http://one.org/x#", "http://two.org/x#"
    assert got == {(one + "i1", one + "Bank"), (one + "i1", one + "Institution"), (two + "i2", two + "Bank"), (two + "i2", two + "Terrain")}
    with pytest.raises(ValueError, match="Bank"):
        rdf.graph_of(t)


def test_a_clash_rejects_its_own_file_alone(spark, tmp_path):
    facts = "a:i1 a a:Bank , a:Institution . a:Bank a owl:Class ."
    at = folder(tmp_path, good=facts, bad=facts + " a:Bank owl:disjointWith a:Institution .")
    g = M.graphs_of(rdf.read_rdf(spark, at))
    m = R.materialize(g)
    found = M.clashing(R.clashes(m, m.types, m.relations, m.same))
    assert [(r["graph_id"], r["rule"], r["a"]) for r in found.collect()] == [("bad", "disjoint_classes", "http://one.org/x#i1")]
    assert rows(R.keep_consistent(M.own_names(m.types, "s"), found).select("graph_id").distinct()) == {("good",)}


def test_axioms_of_files(spark, tmp_path):
    at = folder(
        tmp_path, f="""a:C owl:equivalentClass [ owl:intersectionOf ( a:A [ a owl:Restriction ; owl:onProperty a:p ; owl:someValuesFrom a:B ] a:D ) ] . a:E owl:unionOf ( a:A a:B ) . a:U owl:disjointUnionOf ( a:A a:B a:D ) .
        a:p owl:propertyChainAxiom ( a:q a:r ) ; a owl:TransitiveProperty . a:A owl:hasKey ( a:k a:l ) . [] a owl:AllDifferent ; owl:distinctMembers ( a:x a:y a:z ) . [] a owl:AllDisjointClasses ; owl:members ( a:F a:G a:H ) .
        a:M rdfs:subClassOf [ a owl:Restriction ; owl:onProperty a:p ; owl:maxQualifiedCardinality "1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger> ; owl:onClass a:B ] . a:N owl:complementOf a:A . [] a owl:Class ; owl:complementOf a:B ; rdfs:subClassOf a:A .""",
    )
    got = rows(M.axioms_of(rdf.read_rdf(spark, at)).selectExpr("kind", "regexp_replace(id, 'http://[^#]*#', '') AS id", "regexp_replace(a, 'http://[^#]*#', '') AS a", "regexp_replace(b, 'http://[^#]*#', '') AS b", "at", "n"))
    by = lambda kind: {r[1:] for r in got if r[0] == kind}
    assert {(a, at, n) for _, a, _, at, n in by("and") if not a.startswith("_:")} == {("A", 0, 3), ("D", 2, 3)} and len(by("and")) == 3
    assert {(i, a, at) for i, a, _, at, _ in by("or")} == {("_:or of E", "A", 0), ("_:or of E", "B", 1), ("_:or of U", "A", 0), ("_:or of U", "B", 1), ("_:or of U", "D", 2)}
    assert {(a, b, at, n) for _, a, b, at, n in by("chain")} == {("q", "p", 0, 2), ("r", "p", 1, 2)} and {(a, b, at) for _, a, b, at, _ in by("key")} == {("A", "k", 0), ("A", "l", 1)}
    assert {a for _, a, *_ in by("different")} == set("xyz") and {(a, at) for i, a, _, at, _ in by("disjoint") if not i.startswith("union")} == {("F", 0), ("G", 1), ("H", 2)}
    assert {(a, b, n) for _, a, b, _, n in by("max")} == {("p", "B", 1)} and {(a, b) for _, a, b, *_ in by("some")} == {("p", "B")} and by("transitive") == {(None, "p", None, None, None)}
    assert len(by("not")) == 2 and ("_:or of E" in {b for _, a, b, *_ in by("equivalent") if a == "E"})


def test_two_hop_counts_equal_modules(spark):
    rng = random.Random(12)
    for n, m in ((1, 0), (4, 9), (9, 30), (14, 25)):
        types = sorted({(f"i{rng.randrange(n)}", rng.choice("AB")) for _ in range(n)})
        relations = sorted({(f"i{rng.randrange(n)}", rng.choice("pq"), f"i{rng.randrange(n)}") for _ in range(m)})
        g = Graph(spark.createDataFrame(types, "s string, c string"), spark.createDataFrame(relations, "s string, p string, o string"), Schema())
        want = {r["x"]: r["count"] for r in H.hop(g, 2).groupBy("x").count().collect()}
        assert dict(rows(H.hop2_counts(g))) == want
        near, blocks = H.hop2_blocks(g)
        assert rows(near.join(blocks, "y").select("x", "axiom").distinct()) == rows(H.hop(g, 2).select("x", "axiom"))


def test_rewriting_takes_time_in_proportion(spark, monkeypatch):
    import time

    from quillon.operators import abstraction as B

    names = [("Foo", "C1"), ("Foo bar", "C2"), ("a-b", "P1"), ("bar", "C3"), ("Foo bar baz", "C4")]
    m = spark.createDataFrame(names, "original string, abstract_name string")
    said = "Foo bar, Food a-b bar Foo bar ba Foo bar baz.\n"
    want = "C2, Food P1 C3 C2 ba C4.\n"
    df = spark.createDataFrame([(said, 1), (None, 2), ("", 3), (said * 25_000, 4)], "t string, n int")  # the last is over 1 MB
    for most in (B.TRIE_NAMES, 0):
        monkeypatch.setattr(B, "TRIE_NAMES", most)
        few = df if most else df.where("n < 4")
        began = time.time()
        got = {r["n"]: r["t"] for r in B.rewrite(few, "t", m).collect()}
        assert time.time() - began < 90 and got[1] == want and got[2] == got[3] == "" and got.get(4, want * 25_000) == want * 25_000


def test_calls_in_flight_are_bounded_and_paced(spark):
    from quillon.operators import responders as A

    clock = [0.0]
    pace = A.Pace(4.0, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(9):
        pace.wait()
    assert clock[0] == 2.0
    q = spark.createDataFrame([(f"t{k}", f"prompt {k}") for k in range(40)], "task_id string, prompt string")

    def moody(model: str, prompt: str) -> str:
        import time

        time.sleep(0.05)
        if prompt.endswith("7"):
            raise A.PermanentError("no")
        return A.offline(model, prompt)

    got = {(r["task_id"], r["model"]): r["response"] for r in A.run_questions(q, ["a", "b"], moody, workers=2, calls=5, wait=0.0).collect()}
    assert len(got) == 80 and all((v == "[ERROR] no") == k[0].endswith("7") for k, v in got.items())
    assert all(v == A.offline(m, f"prompt {t[1:]}") for (t, m), v in got.items() if not t.endswith("7"))


def test_commands_feed_each_other(spark, tmp_path, monkeypatch):
    """reason on a folder with an inconsistent file, sample on its questions, its explanations read again."""
    import json

    from quillon import cli
    from quillon.sources import text as S

    monkeypatch.setattr(cli, "local_session", lambda name: spark)
    (tmp_path / "in").mkdir()
    schema = "a:Man rdfs:subClassOf a:Person . a:Father rdfs:subClassOf a:Man . a:p rdfs:subPropertyOf a:q ; rdfs:domain a:Father ; owl:inverseOf a:c . a:q a owl:TransitiveProperty . "
    people = " ".join(f"a:i{k} a a:Father ; a:p a:i{k + 1} ." for k in range(8))
    folder(tmp_path / "in", one=schema + people, two=schema + "a:i1 a a:Father ; a:p a:j .", bad=schema + "a:Man owl:disjointWith a:Father . a:z a a:Father .")
    at = lambda name: str(tmp_path / name)
    cli.main(["reason", at("in"), at("r")])
    assert {r["graph_id"] for r in spark.read.json(at("r/clashes")).collect()} == {"bad"}
    q = S.read_questions(spark, at("r/questions")).collect()
    by = {r["SPARQL Query"]: r for r in q}
    assert len(by) == len(q) and {r["Root Entity"] for r in q} == {"one", "two"}  # each query once, for its first file
    one = by["ASK WHERE { <i1> rdf:type <Person> }"]
    assert one["Root Entity"] == "one" and one["Size of ontology TBox"] == 6 and one["Size of ontology ABox"] == 9 and one["Task ID"] == "1hop-one_i1-i1-rdf:type-BIN" and 0 < one["Min Tag Length"] <= one["Max Tag Length"]
    assert by["SELECT ?x WHERE { <i6> <q> ?x }"]["Answer"] == "i7; i8" and by["ASK WHERE { <i1> <p> <j> }"]["Root Entity"] == "two"
    told = json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "r" / "explanations_json").glob("part-*"))))
    e = told["i1|rdf:type|Person"]
    assert e["size"]["min"] <= e["size"]["max"] and e["explanationCount"] == len(e["explanations"]) and all(x[-1].startswith("TAG:") for x in e["explanations"])
    assert ["i1 rdf:type Father", "Father rdfs:subClassOf Man", "Man rdfs:subClassOf Person", "TAG:DHH"] in e["explanations"] and "1hop-one_i1-i1-rdf:type-BIN" in e["taskIds"]
    assert not any("//" in json.dumps(x) for x in told.values()) and not any(k.startswith("z|") for k in told)
    cli.main(["sample", at("r/questions"), at("s"), "--test-size", "0.3"])
    kept = S.read_questions(spark, at("s")).collect()
    assert 0 < len(kept) < len(q) and {r["SPARQL Query"] for r in kept} <= set(by) and kept[0]["Task Type"] in ("Membership", "Property Assertion")
    # One question by hand: every fact that a file entails and explains is asked once.
    assert {k for k in told} >= {f"i{k}|rdf:type|Person" for k in range(8)} | {"i1|q|i3", "i2|c|i1", "i1|p|j"}


def test_distances_move_the_lowest_nodes_once(spark, monkeypatch):
    rng = random.Random(3)
    up = sorted({(f"m{a}", f"m{b}") for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(14)) if a != b})  # with cycles
    pairs = up + sorted({(f"low{k}", f"m{rng.randrange(9)}") for k in range(12) for _ in range(3)})
    want = set()
    for start in {a for a, _ in pairs}:
        level, seen, n = {start: start}, {start}, 0
        while level:
            n += 1
            nearer = sorted((a, b) for a, b in pairs if a in level and b not in seen)
            level = {b: min(x for x, y in nearer if y == b) for _, b in nearer}
            want |= {(start, b, n, via) for b, via in level.items()}
            seen |= set(level)
    rounds, gone = C._rounds_of_distances, []
    monkeypatch.setattr(C, "_rounds_of_distances", lambda e: gone.append(rows(e)) or rounds(e))
    for most in (1 << 16, 0):
        monkeypatch.setattr(C, "BROADCAST_ROWS", most)
        assert rows(C.distances(spark.createDataFrame(pairs, "a string, b string"))) == want
    assert gone == [{(a, b) for a, b in up if a in {y for _, y in pairs}}] * 2
