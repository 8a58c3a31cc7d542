"""Names, answers, statistics, abstraction, JSON, ontology files and responders."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import answers as A
from quillon.functions import names as N
from quillon.operators import abstraction as B
from quillon.operators import responders as P
from quillon.operators import stats as S
from quillon.operators import verbalize as V
from quillon.operators.model import Schema
from quillon.sources import rdf
from quillon.sources import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("John_Heath 1840; x", ["johnheath", "x"]), ("john_heath_1840", ["johnheath1840"]), ("", []), ("1840", []), ("A, B , a", ["a", "b"]), ("  TRUE ", ["true"]), ("é; b", ["b"])],
)
def test_clean_answer(spark, text, want):
    assert one(spark, A.clean_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize(("e", "a", "kind", "want"), [("TRUE", "true", "BIN", 1.0), ("TRUE", "FALSE", "BIN", 0.0), ("a; b", "b; c", "MC", 1 / 3), ("", "", "MC", 1.0), ("", "x", "MC", 0.0)])
def test_jaccard(spark, e, a, kind, want):
    assert one(spark, A.jaccard(A.clean_answer(F.col("e")), A.clean_answer(F.col("a")), F.col("k")), e=e, a=a, k=kind) == pytest.approx(want)


def test_parsing_bounds(spark):
    assert one(spark, A.confidence(F.col("r")), r="CONFIDENCE: 7.5") == 1.0 and one(spark, A.confidence(F.col("r")), r="none") == 0.5
    assert one(spark, A.reasoning_steps(F.col("r")), r="reasoning_steps: 42") == 10
    assert one(spark, A.final_answer(F.col("r"), F.lit("BIN")), r="[ERROR] x") == "ERROR" and one(spark, A.final_answer(F.col("r"), F.lit("MC")), r="ANSWER: <http://x#Foo>, ns1:b") == "Foo, b"
    assert one(spark, A.hallucination_rate(F.col("a"), F.col("e"), F.col("c"), F.lit("MC")), a="Foo; zzz", e="foo", c="") == 0.5


def test_names(spark):
    assert one(spark, N.entity_label(F.col("n")), n="john_heath_1840") == "John Heath" and one(spark, N.local_name(F.col("n")), n="http://x/y#") == "http://x/y#"
    assert one(spark, N.file_name(F.array(F.lit("B"), F.lit("A"), F.lit("C")), F.col("n")), n="x y/z") == "A_B_x_y_z"
    assert one(spark, N.oxford_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b, and c"


@given(st.lists(st.integers(0, 50), min_size=2, max_size=40))
@settings(max_examples=8, deadline=None)
def test_bins_cover_all(spark, values):
    got = [r["b"] for r in S.cut(spark.createDataFrame([(v,) for v in values], "v int"), "v", "b").collect()]
    assert min(got) == 0 and len(got) == len(values)


def test_split_size():
    assert S.split_size(100, 3, 0.95) == 95 and S.split_size(10, 4, 0.95) == 6
    with pytest.raises(ValueError):
        S.split_size(3, 2, 0.5)
    with pytest.raises(ValueError):
        S.split_size(0, 0, 0.5)


def test_sampling_ignores_partitions(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 3).cast("string").alias("strata"))
    a = {r["id"] for r in S.stratified_keep(df.repartition(7), "id").collect()}
    assert a == {r["id"] for r in S.stratified_keep(df.coalesce(1), "id").collect()} and len(a) == 20


def test_rewrite(spark):
    m = B.mapping(spark.createDataFrame([("Foo", "class"), ("Foo", "individual"), ("bar", "object_property"), ("Thing", "class")], "term string, category string"))
    assert {r["original"]: r["abstract_name"] for r in m.collect()} == {"Foo": "Class1", "bar": "Property1"}
    got = B.rewrite(spark.createDataFrame([("Foo bar, Food bar?",), (None,)], "t string"), "t", m).collect()
    assert sorted(r["t"] for r in got) == ["", "Class1 Property1, Food Property1?"]


def test_rewrite_names_with_marks(spark):
    names = ["Brand#17", "has-part", "part", "North West", "North", "a.b.c", "Ω mega"]
    m = B.mapping(spark.createDataFrame([(n, "class") for n in names], "term string, category string"))
    to = {r["original"]: r["abstract_name"] for r in m.collect()}
    text = "is Brand#17 has-part foo, part of (North West) or North; xa.b.c a.b.c. Brand#170 Ω mega!"
    want = f"is {to['Brand#17']} {to['has-part']} foo, {to['part']} of ({to['North West']}) or {to['North']}; xa.b.c {to['a.b.c']}. Brand#170 {to['Ω mega']}!"
    df = spark.createDataFrame([(1, text, 7), (1, text, 7), (2, "", 8), (3, None, 9)], "_row int, _tok string, _map int")
    got = B.rewrite(df, "_tok", m)
    assert got.columns == df.columns and sorted(r["_tok"] for r in got.collect()) == sorted([want, want, "", ""])
    assert [r["_tok"] for r in B.rewrite(df.limit(1), "_tok", m.limit(0)).collect()] == [text]


def test_rewrite_turtle(spark):
    m = B.mapping(spark.createDataFrame([("Foo", "class"), ("x-1", "individual")], "term string, category string"))
    base = "http://www.example.com/abstracted.owl#"
    uri = spark.createDataFrame([("f", "###  http://e/o#Foo\n<http://e/o#x-1> a <http://e/o#Foo> , <http://e/o#Other> ; <http://z/o#Foo> 1 .")], "file string, text string")
    assert B.rewrite_turtle(uri, "text", m, "uri", "http://e/o").first()["text"] == f"###  {base}Class1\n<{base}Individual1> a <{base}Class1> , <http://e/o#Other> ; <http://z/o#Foo> 1 ."
    pre = spark.createDataFrame([("ns1:x-1 a ns1:Foo, ns1:Food ; p:ns1:Foo 2 .",), (None,)], "text string")
    assert sorted(r["text"] for r in B.rewrite_turtle(pre, "text", m, "prefix", "ns1").collect()) == ["", f"<{base}Individual1> a <{base}Class1>, ns1:Food ; p:ns1:Foo 2 ."]
    assert [r["line"] for r in B.mapping_lines(m).collect()] == ["=== CLASSES ===", f"Foo -> <{base}Class1>", "=== INDIVIDUALS ===", f"x-1 -> <{base}Individual1>"]


def test_running_sums(spark):
    from quillon.plans.skew import running

    rows = [("a", k % 97, k, 1 + k % 5) for k in range(800)] + [("b", k, k, 2) for k in range(30)]
    df = spark.createDataFrame(rows, "g string, v int, id int, w int").repartition(5)
    got = {(r["g"], r["id"]): (r["n"], r["s"]) for r in running(running(df, ["g"], ["v", "id"], "n"), ["g"], ["v", "id"], "s", "w").collect()}
    for g in "ab":
        upto = 0
        for n, (_, v, i, w) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            upto += w
            assert got[g, i] == (n, upto)


def test_salted_join(spark, monkeypatch):
    from quillon.plans import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    many = spark.createDataFrame([("hot", k) for k in range(50)] + [("cold", 1), ("none", 2)], "k string, v int")
    one = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("cold", "z"), ("extra", "q")], "k string, o string")
    hot = skew.hot_keys(many.groupBy("k").count(), ["k"], "count", many.count())
    for how in ("inner", "left"):
        assert sorted(map(str, skew.salted_join(many, one, ["k"], "v", hot, how).collect())) == sorted(map(str, many.join(one, "k", how).collect()))
    assert hot.first()["_parts"] == 17


def test_settled_tables_are_released(spark):
    from pathlib import Path

    from quillon.plans.lineage import release, settle

    t = settle(spark.range(5).toDF("id"))
    at = Path(t._settled_at.removeprefix("file://").removeprefix("file:"))
    assert t.count() == 5 and at.exists()
    release(t, spark.range(1))
    assert not at.exists()


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), "id", (F.rand(3) * 10 + (F.col("id") % 2)).alias("v"))
    df = spark.createDataFrame(df.collect(), df.schema)
    for r in S.bootstrap_ci(df, "g", "id", "v", 400).collect():
        m = df.where(F.col("g") == r["g"]).agg(F.avg("v"), F.stddev("v"), F.count("v")).first()
        half = 1.96 * m[1] / m[2] ** 0.5
        assert abs(r["low"] - (m[0] - half)) < 0.3 * half and abs(r["high"] - (m[0] + half)) < 0.3 * half


BAD = ['{"a": 1}', '{"a": 1,\n,\n"b": 2}', '{"a": 1,}', '{"a": 1', '{"a": {"x": 1},,"b": 2}']


@pytest.mark.parametrize("text", BAD)
def test_repair(spark, text):
    import json

    assert json.loads(one(spark, X.repair_json(F.col("t")), t=text))["a"]


def test_partial_json(spark):
    got = X.partial_json(spark.createDataFrame([(1, '{"a": 1, "b": [2], "c": {"d"'), (2, ""), (3, None)], "k int, t string"), "k", "t").collect()
    assert [(r["k"], r["name"], r["value"]) for r in got] == [(1, "a", "1"), (1, "b", "[2]")]


TURTLE = """@prefix : <http://e.org/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# a comment
:p a owl:ObjectProperty , owl:SymmetricProperty ; rdfs:domain :C ; owl:propertyChainAxiom ( :q :r ) .
:C rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :D ] , :D .
:x a :C ; :p :y ; :age 7 ; :h 1.5e3 ; rdfs:label "X \\"q\\""@en , 'plain' ; :t "2"^^<http://www.w3.org/2001/XMLSchema#int> ; :ok true .
_:b1 :p :x ."""
XML = """<?xml version="1.0"?><rdf:RDF xmlns="http://e.org/o#" xml:base="http://e.org/o" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
<owl:Class rdf:about="#C"><owl:equivalentClass><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#D"/><rdf:Description rdf:about="#E"/></owl:unionOf></owl:Class></owl:equivalentClass></owl:Class>
<owl:NamedIndividual rdf:about="#x"><rdf:type rdf:resource="#C"/><p rdf:resource="#y"/><rdfs:label xml:lang="EN">X</rdfs:label></owl:NamedIndividual></rdf:RDF>"""


def test_rdf(spark, tmp_path):
    (tmp_path / "one.ttl").write_text(TURTLE)
    (tmp_path / "two.OWL").write_text(XML)
    (tmp_path / "bad.ttl").write_text(":x :y")
    (tmp_path / "skip.txt").write_text("x")
    t = rdf.read_rdf(spark, str(tmp_path)).cache()
    assert {r["graph_id"] for r in t.where("_error is not null").collect()} == {"bad"}
    g = rdf.graph_of(t.where("graph_id = 'one'"))
    assert {tuple(r) for r in g.relations.collect()} == {("x", "p", "y")} and {tuple(r) for r in g.types.collect()} == {("x", "C")}
    assert g.schema.symmetric == ["p"] and g.schema.chains == [(("q", "r"), "p")] and g.schema.domain == [("p", "C")] and [e.kind for e in g.schema.expressions.values()] == ["some"]
    g = rdf.graph_of(t.where("graph_id = 'two'"))
    assert [e.operands for e in g.schema.expressions.values()] == [("D", "E")] and {tuple(r) for r in g.relations.collect()} == {("x", "p", "y")}
    back = rdf.to_turtle(t.where("graph_id = 'one'")).first()["turtle"]
    first = [x for x in rdf.parse_turtle(TURTLE, "one")]
    assert len(set(rdf.parse_turtle(back, "one"))) == len(set(first))


RESTRICTIONS = """@prefix : <http://e.org/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .
:A owl:equivalentClass [ a owl:Restriction ; owl:onProperty :p ; owl:hasValue :red ] .
:B owl:equivalentClass [ a owl:Restriction ; owl:onProperty :p ; owl:minCardinality 2 ] .
:C owl:equivalentClass [ a owl:Restriction ; owl:onProperty :p ; owl:maxQualifiedCardinality 3 ; owl:onClass :D ] .
:E owl:equivalentClass [ a owl:Restriction ; owl:onProperty :p ; owl:cardinality 1 ] .
:x owl:sameAs :y . :x owl:differentFrom :z . [ a owl:AllDifferent ; owl:distinctMembers ( :x :z :w ) ] .
:x rdfs:label "b" , "a" . :y skos:prefLabel "why" ."""


def test_restrictions_equalities_and_labels(spark, tmp_path):
    (tmp_path / "r.TtL").write_text(RESTRICTIONS)
    t = rdf.read_rdf(spark, str(tmp_path)).cache()
    g = rdf.graph_of(t)
    kinds = {(e.kind, e.n, e.filler) for e in g.schema.expressions.values()}
    assert kinds == {("value", None, "red"), ("min", 2, None), ("max", 3, "D"), ("exact", 1, None)}
    assert {tuple(r) for r in g.same.collect()} == {("x", "y")} and {r["s"] for r in g.different.collect()} == {"x", "z"} and {s for _, s in g.schema.all_different} == {"x", "z", "w"}
    assert {r["entity"].split("#")[1]: r["text"] for r in rdf.labels_of(t).collect()} == {"x": "a", "y": "why"}
    said = V.classes(g.schema)
    assert "at least 2" in said["B"] and "at most 3" in said["C"] and "exactly 1" in said["E"] and "Red" in said["A"]


def test_stream_survives_broken_files(spark, tmp_path):
    from quillon.streaming.ontologies import stream_triples

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.owl").write_text("<?xml version='1.0'?><rdf:RDF")
    (tmp_path / "in" / "good.ttl").write_text(TURTLE)
    stream_triples(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["graph_id"] for r in out.where("_error is not null").collect()} == {"bad"} and out.where("graph_id = 'good' and _error is null").count() > 5


def test_windowed_counts(spark):
    from quillon.streaming.ontologies import windowed_counts

    events = spark.createDataFrame([(f"2024-01-01 00:{m:02}:00", "a") for m in (1, 9, 11)], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    assert sorted(r["n"] for r in windowed_counts(events).collect()) == [1, 2]


def test_command_line(spark, tmp_path, monkeypatch):
    """Consistent and inconsistent ontologies, modules with the schema, verbalisation by labels, abstracted files."""
    from quillon import cli

    monkeypatch.setattr(cli, "local_session", lambda name: spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.ttl").write_text(TURTLE)
    at = lambda name: str(tmp_path / name)
    cli.main(["reason", at("in"), at("r")])
    assert spark.read.parquet(at("r/explanations")).count() > 0 and not (tmp_path / "r" / "clashes").exists()
    cli.main(["extract", at("in"), at("e"), "--hops", "1", "--with-schema"])
    assert spark.read.parquet(at("e/1hop")).where("axiom like 'Domain%'").count() > 0
    cli.main(["verbalize", at("in"), at("v"), "--lines", "--metadata", at("m")])
    assert "individuals" in {r["section"] for r in spark.read.json(at("v")).collect()} and "verbalized_tbox" in spark.read.text(at("m"), wholetext=True).first()[0]
    cli.main(["abstract", at("in"), at("a")])
    assert spark.read.text(at("a/mapping")).count() >= 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "two.ttl").write_text("@prefix : <http://e/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . :A owl:disjointWith :B . :x a :A , :B .")
    cli.main(["reason", at("bad"), at("c")])
    assert spark.read.json(at("c/clashes")).count() > 0 and not (tmp_path / "c" / "questions").exists()


def test_explanation_file_is_json(spark, tmp_path):
    import json

    rows = spark.createDataFrame([('a"b', "p", "c", [["x"]], 1, 2, 1, ["t"], ["q"]), ("d", "p", "e", [["y", "z"]], 1, 1, 1, [], [])], "s string, p string, o string, explanations array<array<string>>, min_size int, max_size int, explanation_count int, task_ids array<string>, sparql_queries array<string>")
    X.write_explanations(X.explanation_json(rows), str(tmp_path / "x"))
    got = json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*"))))
    assert set(got) == {'a"b|p|c', "d|p|e"} and got["d|p|e"]["explanations"] == [["y", "z"]]
    assert {r["triple_key"] for r in X.read_explanations(spark, str(tmp_path / "x")).collect()} <= set(got)
    assert json.loads("".join(r["value"] for r in X.explanation_lines(X.explanation_json(rows.limit(0))).collect())) == {}


def test_prompts_have_three_forms(spark):
    said = {k: one(spark, A.prompt(F.lit("q"), F.lit("c"), F.col("k"), "json"), k=k) for k in ("BIN", "Multi Choice", "Open")}
    assert len(set(said.values())) == 3 and "TRUE or FALSE" in said["BIN"]


def test_stream(spark, tmp_path):
    from quillon.streaming.ontologies import stream_triples

    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.ttl").write_text(TURTLE)
        stream_triples(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r["graph_id"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("graph_id").count().collect()}.keys() == {"a", "b"}


def test_mapping_and_questions(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Original -> Abstract\n=== CLASSES ===\n\nFoo -> <http://e#Class1>\nbar -> <plain>\n")
    assert {r["original"]: r["abstract_name"] for r in X.read_mapping(spark, str(tmp_path / "m.txt")).collect()} == {"Foo": "Class1", "bar": "plain"}
    row = ("t", "r", 1, 2, "Membership", "BIN", 'ASK { "q",\n}', "p", "a", 1, 2)
    X.write_questions(spark.createDataFrame([row], X.QUESTION_SCHEMA), str(tmp_path / "q"))
    assert X.read_questions(spark, str(tmp_path / "q")).first()["SPARQL Query"] == 'ASK { "q", }'
    wide = spark.createDataFrame([("t", "TRUE", "0.5")], "id string, m_final_answer string, m_confidence_score string")
    assert [(r["model"], r["final_answer"], r["response"]) for r in X.to_long(wide, ["id"]).collect()] == [("m", "TRUE", None)]


def test_run_and_resume(spark, tmp_path):
    q = spark.createDataFrame([(1, "p1"), (2, "p2")], "task_id int, prompt string")
    first = P.run_questions(q.where("task_id = 1"), ["a", "b"], workers=2)
    P.append_checkpoint(first, str(tmp_path / "c"))
    rest = P.run_questions(q, ["a", "b"], done=spark.read.parquet(str(tmp_path / "c")), workers=2)
    assert sorted((r["task_id"], r["model"]) for r in rest.collect()) == [(2, "a"), (2, "b")]

    def broken(model, prompt):
        raise P.PermanentError("no")

    assert P.patient(broken)("m", "p") == "[ERROR] no" and P.model_spec("x:y/z") == ("x", "y/z", "x_y_z")


def test_individuals(spark):
    t = spark.createDataFrame([("ada_1868", "Woman")], "s string, c string")
    r = spark.createDataFrame([("ada_1868", "isSisterOf", "gwen_1870"), ("john_1840", "isFatherOf", "ada_1868"), *((f"m{k}", "knows", "ada_1868") for k in range(9))], "s string, p string, o string")
    got = {x["s"]: x["description"] for x in V.individuals(t, r, Schema()).collect()}
    assert got["ada_1868"] == "Ada is an instance of Woman. Ada is sister of Gwen. John is father of Ada."
    assert "knows" not in got["ada_1868"]
    labels = spark.createDataFrame([("ada_1868", "Lady Ada"), ("john_1840", "old john")], "entity string, text string")
    named = {x["s"]: (x["label"], x["description"]) for x in V.individuals(t, r, Schema(), labels=labels).collect()}
    assert named["ada_1868"] == ("Lady Ada", "Lady Ada is an instance of Woman. Lady Ada is sister of Gwen. Old John is father of Lady Ada.")


def test_checkpoints_resume(spark, tmp_path):
    q = spark.createDataFrame([(k, f"p{k}") for k in range(7)], "task_id int, prompt string")
    asked = spark.sparkContext.accumulator(0)

    def ask(model, prompt):
        asked.add(1)
        return P.offline(model, prompt)

    at = f"file://{tmp_path}/run"
    first = P.run_with_checkpoints(q.where("task_id < 4"), ["a", "b"], at, ask, every=3, workers=2)
    assert first.count() == 8 and spark.read.json(f"{at}/LATEST").first()["part"] == 1
    every = P.run_with_checkpoints(q, ["a", "b"], at, ask, every=3, workers=2)
    assert every.select("task_id", "model").distinct().count() == every.count() == 14 and asked.value == 14
    assert P.run_with_checkpoints(q, ["a", "b"], at, ask).count() == 14 and asked.value == 14
    assert [r["provider"] for r in P.model_metadata(spark, ["claude-x", "meta:llama", "gpt-9"]).collect()] == ["anthropic", "meta", "openai"]
    with pytest.raises(ValueError, match="no client"):
        P.responder_for("meta:llama", {"openai": P.offline})


def test_workbooks(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Task ID</t></si><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>4.5</v></c></row><row><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    base = f"file://{tmp_path}"
    assert [tuple(r) for r in X.read_table(spark, f"{base}/r").collect()] == [("bc", None, "4.5"), (None, "TRUE", None)]
    (tmp_path / "c.csv").write_text('x,y\n1,"a, b"\n')
    assert X.read_table(spark, f"{base}/c").first()["y"] == "a, b"
    with pytest.raises(FileNotFoundError):
        X.read_table(spark, f"{base}/none")


def test_contexts_by_mode(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b":[1]}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "c.ttl").write_text(":x :y :z .")
    got = {r["root_entity"]: r["context"] for r in X.read_contexts(spark, str(tmp_path), "json").collect()}
    assert got["bad"] == "{" and "\n" in got["a"] and set(got) == {"a", "bad"}
    assert [r["context"] for r in X.read_contexts(spark, str(tmp_path), "ttl").collect()] == [":x :y :z ."]


def test_module_files(spark, tmp_path):
    (tmp_path / "one.ttl").write_text(TURTLE)
    t = rdf.read_rdf(spark, str(tmp_path / "one.ttl"))
    text = rdf.module_turtle(t, 'Subgraph "{}"', "a comment", "1").first()["turtle"]
    assert 'label> "Subgraph \\"one\\""@en .' in text and len(list(rdf.parse_turtle(text, "one"))) >= 4 + len(set(rdf.parse_turtle(TURTLE, "one")))
    rdf.write_turtle(rdf.module_turtle(t, "x", "y", "z"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "graph_id=one").exists()


def test_categories_of_turtle_terms(spark):
    text = """ns1:A a owl:Class . ns1:p rdf:type owl:ObjectProperty . ns1:d a owl:AnnotationProperty . ns1:i a owl:NamedIndividual .
ns1:B rdfs:subClassOf ns1:C . ns1:q rdfs:domain ns1:B . ns1:j a ns1:A . ns1:j ns1:verb ns1:k9 . x ns1:between y ."""
    df = spark.createDataFrame([(text,)], "t string")
    got = {r["term"]: r["category"] for r in B.categorized(df, "t", "prefix", "ns1").collect()}
    assert got == {"A": "class", "p": "object_property", "d": "data_property", "i": "individual", "B": "class", "C": "class", "q": "object_property", "j": "individual", "verb": "object_property", "k9": "individual", "between": "object_property"}
    uri = spark.createDataFrame([("<http://e/o#A> a <http://www.w3.org/2002/07/owl#Class> . <http://e/o#U1> <http://e/o#has> <http://z#B> .",)], "t string")
    assert {r["term"]: r["category"] for r in B.categorized(uri, "t", "uri", "http://e/o").collect()} == {"A": "class", "U1": "individual", "has": "object_property"}


def test_nested_lines_are_json(spark):
    import json

    from quillon.operators import benchmark as K

    rows = spark.createDataFrame([("b", 1, "x"), ("a", 2, 'y"'), ("a", 1, "z"), (None, 1, "w")], "k string, n int, t string")
    got = json.loads("".join(r["value"] for r in K.nested_lines(rows, ["k"], ["n", "t"]).collect()))
    assert got == [{"k": "a", "qas": [{"n": 1, "t": "z"}, {"n": 2, "t": 'y"'}]}, {"k": "b", "qas": [{"n": 1, "t": "x"}]}]
    assert json.loads("".join(r["value"] for r in K.nested_lines(rows.limit(0), ["k"], ["n", "t"]).collect())) == []


def test_reports(spark):
    import json

    from quillon.operators import reports as O

    timers = O.Timers()
    with timers.step("a"):
        pass
    assert [r["step"] for r in timers.table(spark).orderBy("rank").collect()] == ["total", "a"] and O.Config().row(spark).first()["batch_size"] == 25
    line = one(spark, O.tagged_record(F.lit('k"'), F.lit("e"), F.lit("DH"), F.lit("2024-01-01 00:00:00").cast("timestamp")), x=1)
    assert json.loads("{" + line + "}") == {'k"': {"explanation": "e", "tags": "DH", "timestamp": 1704067200000}}
    assert [one(spark, O.ontology_name(F.lit(x)), y=1) for x in ("http://e/onto", None)] == ["onto", "unknown"]


def test_deep_property_traces(spark):
    """EXP-7: a sub-property of a chain, of an inverse, and the inverse of a sub-property."""
    from quillon.operators import explain as E
    from quillon.operators.model import Graph

    rel = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("x", "r", "y"), ("m", "u", "n")], "s string, p string, o string")
    typ = spark.createDataFrame([], "s string, c string")
    g = Graph(typ, rel, Schema(chains=[(("p", "q"), "t")], subproperty=[("t", "top"), ("rInv", "up"), ("u", "v")], inverse=[("r", "rInv"), ("v", "w")]))
    got = {(r["s"], r["p"]): r["said"] for r in E.property_trace(E.Facts(g, typ, rel, typ, rel)).collect()}
    assert got["a", "top"] == ["t rdfs:subPropertyOf top", "PropertyChain(p o q) -> t", "a p b", "b q c"]
    assert got["y", "up"] == ["rInv rdfs:subPropertyOf up", "r owl:inverseOf rInv", "x r y"]
    assert got["n", "w"] == ["v owl:inverseOf w", "u rdfs:subPropertyOf v", "m u n"] and got["m", "v"] == ["u rdfs:subPropertyOf v", "m u n"]


def test_structural_type(spark):
    kinds = {k: one(spark, V.structural_type(*(F.lit(x) for x in k)), t=1) for k in [(20, 30, 60), (10, 30, 60), (10, 20, 60), (10, 20, 50)]}
    assert [*kinds.values()] == ["hierarchical", "relational", "instance_heavy", "general"]
