"""Command line: ``python -m quillon.cli COMMAND ...`` (CFG-1)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from quillon.session import local_session


def extract(a) -> None:
    from quillon.operators.hops import hop, with_schema
    from quillon.sources.rdf import graph_of, read_rdf

    spark = local_session("extract")
    g = graph_of(read_rdf(spark, a.input, a.recursive))
    for k in range(1, a.hops + 1):
        rows = hop(g, k)
        (with_schema(g, rows) if a.with_schema else rows).write.mode("overwrite").parquet(f"{a.output}/{k}hop")


def reason(a) -> None:
    """Entails, explains and asks, each file as an ontology of its own; inconsistent ones give their clashes and nothing else (FLT-15)."""
    from quillon.plans import reasoner
    from quillon.plans.lineage import settle
    from quillon.sources.rdf import read_rdf
    from quillon.sources.text import explanation_json, write_explanations, write_questions

    spark = local_session("reason")
    r = reasoner.reason(read_rdf(spark, a.input, a.recursive), a.existentials, not a.no_equality)
    if not r.clashes.isEmpty():
        r.clashes.write.mode("overwrite").json(f"{a.output}/clashes")
        for row in r.clashes.groupBy("graph_id").count().orderBy("graph_id").limit(20).collect():
            print(f"inconsistent ontology: {row['graph_id']}; see {a.output}/clashes")
    if r.facts.isEmpty():
        return
    r.paths.write.mode("overwrite").parquet(f"{a.output}/explanations")
    questions = settle(reasoner.question_rows(r, a.label))
    write_questions(questions, f"{a.output}/questions", "overwrite")
    write_explanations(explanation_json(reasoner.explanation_rows(r, questions)), f"{a.output}/explanations_json")


def sample(a) -> None:
    from quillon.operators.stats import sampled_tasks, strata, stratified_keep
    from quillon.sources.text import read_questions, require_columns

    spark = local_session("sample")
    q = sampled_tasks(require_columns(read_questions(spark, a.input), ["Task ID", "Task Type", "Size of ontology ABox", "Max Tag Length"]))
    stratified_keep(strata(q, "Size of ontology ABox", "Max Tag Length"), "Task ID", a.test_size, a.seed).drop("strata", "task_group").write.mode("overwrite").option("header", True).csv(a.output)


def repair(a) -> None:
    from quillon.sources.text import is_json, repair_json

    spark = local_session("repair")
    fixed = spark.read.text(a.input, wholetext=True).select(repair_json(F.col("value")).alias("value"))
    if a.validate:
        fixed.select(is_json(F.col("value")).alias("valid")).show()
    fixed.write.mode("overwrite").text(a.output)


def evaluate(a) -> None:
    from quillon.operators.scoring import score, summary

    spark = local_session("evaluate")
    summary(score(spark.read.parquet(a.input))).write.mode("overwrite").json(a.output)


def verbalize(a) -> None:
    from quillon.operators.verbalize import document, individuals, metadata_json, sections
    from quillon.sources.rdf import graph_of, labels_of, read_rdf

    spark = local_session("verbalize")
    t = read_rdf(spark, a.input, a.recursive).cache()
    g = graph_of(t)
    from quillon.functions.names import short_form

    labels = labels_of(t).withColumn("entity", short_form(F.col("entity")))
    people = individuals(g.types, g.relations, g.schema, labels=labels)
    if a.lines:
        sections(people, g.schema).write.mode("overwrite").json(a.output)
    else:
        document(a.name, people, g.schema, t.count()).write.mode("overwrite").text(a.output)
    if a.metadata:
        spark.createDataFrame([(metadata_json(g.schema),)], "value string").coalesce(1).write.mode("overwrite").text(a.metadata)


def abstract(a) -> None:
    """Ontology files with abstract names, and the mapping (ABS-9, ABS-10, SNK-5, SNK-6)."""
    from quillon.operators import abstraction as B
    from quillon.sources.rdf import read_rdf

    spark = local_session("abstract")
    m = B.mapping(B.declared(read_rdf(spark, a.input, a.recursive).where("_error is null"))).cache()
    files = spark.read.text(a.input, wholetext=True, recursiveFileLookup=a.recursive).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    how = B.prefix_mode(files).first()
    mode, name = how["mode"], (how["name"] or "").rstrip("#")
    B.rewrite_turtle(files, "text", m, mode, name).write.mode("overwrite").partitionBy("file").text(f"{a.output}/ontologies")
    B.mapping_lines(m).write.mode("overwrite").text(f"{a.output}/mapping")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillon")
    sub = p.add_subparsers(required=True)
    flag = {"action": "store_true"}
    for name, f, extra in (
        ("extract", extract, [("--hops", {"type": int, "default": 2}), ("--with-schema", flag)]), ("reason", reason, [("--existentials", flag), ("--no-equality", flag), ("--label", {"default": "1hop"})]),
        ("sample", sample, [("--test-size", {"type": float, "default": 0.95}), ("--seed", {"type": int, "default": 42})]), ("repair", repair, [("--validate", flag)]),
        ("evaluate", evaluate, []), ("verbalize", verbalize, [("--name", {"default": "ontology"}), ("--lines", flag), ("--metadata", {})]), ("abstract", abstract, []),
    ):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("output")
        if name in ("extract", "reason", "verbalize", "abstract"):
            c.add_argument("--recursive", action="store_true")
        for option, kw in extra:
            c.add_argument(option, **kw)
        c.set_defaults(run=f)
    a = p.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
