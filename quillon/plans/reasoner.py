"""Reasoning over a folder of ontologies from triples to question rows and explanations (FLT-15, PRJ-9, AGG-1, AGG-4, SNK-2, SNK-3).

Each file is a graph with its own schema, root and consistency; all are reasoned over in the same joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import explain as X
from quillon.operators import graphs as M
from quillon.operators import questions as Q
from quillon.operators import reasoning as R
from quillon.operators import tags as T
from quillon.plans.lineage import settle
from quillon.sources.text import QUESTION_COLUMNS, QUESTION_SCHEMA

#: What precedes the short form of an IRI, within texts, too.
_NAMESPACE = r"[A-Za-z][A-Za-z0-9+.\-]*:(?://)?[^\s,()]*[#/]"


@dataclass
class Reasoned:
    """clashes (graph_id, rule, a, b) of the graphs that were left out; facts (root, s, p, o) that the others entail; their
    paths with tags; sizes (graph_id, tbox, abox) of all graphs.  Names are short forms but in the clashes."""

    clashes: DataFrame
    facts: DataFrame
    paths: DataFrame
    sizes: DataFrame


def _short(c: Column, kind) -> Column:
    if kind.typeName() == "string":
        return F.regexp_replace(c, _NAMESPACE, "")
    if kind.typeName() == "array":
        return F.transform(c, lambda x: _short(x, kind.elementType))
    if kind.typeName() == "struct":
        return F.struct(*[_short(c[f.name], f.dataType).alias(f.name) for f in kind])
    return c


def short_names(rows: DataFrame, but: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """All names of a result in their short forms, in texts, arrays and structs."""
    return rows.select(*[F.col(f.name) if f.name in but else _short(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema])


def reason(triples: DataFrame, existentials: bool = False, equality: bool = True) -> Reasoned:
    """Entails, explains and tags all graphs; those with clashes leave alone."""
    every = M.graphs_of(triples)
    m = R.materialize(every, existentials, equality)
    clashes = settle(M.clashing(R.clashes(m, m.types, m.relations, m.same)))
    typ, rel = R.named_types(every, m.types).select("s", "c"), R.named_relations(m.relations.select("s", "p", "o"))
    g = every
    if not clashes.isEmpty():
        gone = clashes.select(F.col("graph_id").alias("_g")).distinct()
        g = M.without(every, clashes)
        typ, rel = (x.join(gone, M.graph_of_name(F.col("s")) == F.col("_g"), "left_anti") for x in (typ, rel))
    f = X.Facts(g, g.types, g.relations, settle(typ.distinct()), settle(rel.distinct()))
    facts = f.typ.select("s", F.lit(Q.TYPE).alias("p"), F.col("c").alias("o")).unionByName(f.rel)
    facts = short_names(M.own_names(facts, "s")).withColumnRenamed("graph_id", "root").distinct()
    paths = short_names(M.own_names(X.deduplicate(X.explain_all(f)).drop("signature"), "s"))
    sized = M.graph_sizes(every).where("kind IN ('individuals', 'classes', 'properties')")
    abox = F.col("kind") == "individuals"
    sizes = sized.groupBy("graph_id").agg(F.sum(F.when(~abox, F.col("n"))).cast("int").alias("tbox"), F.sum(F.when(abox, F.col("n"))).cast("int").alias("abox"))
    return Reasoned(clashes, settle(facts), T.with_shared_tags(paths), settle(sizes))


def question_rows(r: Reasoned, label: str = "1hop") -> DataFrame:
    """The eleven columns of a question file, for explained facts alone (EXP-42), each query once.

    A query that several graphs ask is kept for the first graph by name (AGG-4).  Tag lengths are those of the fact's paths,
    for a question with several answers of all of them.
    """
    lengths = T.tag_lengths(r.paths, "graph_id", "s", "p", "o").withColumnRenamed("graph_id", "root")
    explained = r.facts.join(lengths, ["root", "s", "p", "o"])
    ask = Q.ask(explained, label, "min_tag_len", "max_tag_len")
    several = explained.groupBy("root", "s", "p").agg(F.min("min_tag_len").alias("min_tag_len"), F.max("max_tag_len").alias("max_tag_len"))
    many = Q.select_(r.facts, label, several)
    rows = ask.unionByName(many)
    first = rows.groupBy("sparql_query").agg(F.min("root_entity").alias("root_entity"))
    rows = rows.join(first, ["sparql_query", "root_entity"]).join(r.sizes.withColumnRenamed("graph_id", "root_entity"), "root_entity")
    source = ("task_id", "root_entity", "tbox", "abox", "task_type", "answer_type", "sparql_query", "predicate", "answer", "min_tag_len", "max_tag_len")
    return rows.select(*[F.col(a).cast(QUESTION_SCHEMA[b].dataType).alias(b) for a, b in zip(source, QUESTION_COLUMNS, strict=True)])


def explanation_rows(r: Reasoned, questions: DataFrame) -> DataFrame:
    """The columns of ``explanation_json``: of every triple its explanations, each with its tag at the end, the shortest
    first, over all graphs that entail it, and the questions whose query asks for it."""
    said = F.concat(X.justification_list(F.col("justifications"), F.col("axioms"), F.col("description")), F.array(F.concat(F.lit("TAG:"), "tag")))
    paths = r.paths.select("s", "p", "o", F.struct("complexity", said.alias("said")).alias("x")).distinct()
    told = paths.groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("x")).alias("x"))
    told = told.select("s", "p", "o", F.transform("x", lambda e: e["said"]).alias("explanations"), F.array_min(F.transform("x", lambda e: e["complexity"])).alias("min_size"), F.array_max(F.transform("x", lambda e: e["complexity"])).alias("max_size"), F.size("x").alias("explanation_count"))
    asked = questions.select(F.col("Task ID").alias("task"), F.col("SPARQL Query").alias("query"))
    plain = Q.ask(r.facts.select(F.lit("").alias("root"), "s", "p", "o").distinct().withColumns({"_s": F.col("s"), "_p": F.col("p"), "_o": F.col("o")}), keep=("_s", "_p", "_o")).select(F.col("sparql_query").alias("query"), "_s", "_p", "_o")
    groups = Q.select_query(F.col("s"), F.col("p"))
    wide = r.facts.select("s", "p", "o").distinct().select(groups.alias("query"), F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
    of = plain.unionByName(wide).join(asked, "query").groupBy("_s", "_p", "_o").agg(F.array_sort(F.collect_set("task")).alias("task_ids"), F.array_sort(F.collect_set("query")).alias("sparql_queries"))
    out = told.join(of, (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("o") == F.col("_o")), "left")
    none = F.array().cast("array<string>")
    return out.select("s", "p", "o", "explanations", "min_size", "max_size", "explanation_count", F.coalesce("task_ids", none).alias("task_ids"), F.coalesce("sparql_queries", none).alias("sparql_queries"))
