"""Questions from inferences (PRJ-4 .. PRJ-9, AGG-3 .. AGG-6, EXP-42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "rdf:type"


def triple_key(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("|", s, p, o)


def split_key(key: Column) -> Column:
    """The three parts of a key; further bars belong to the object."""
    parts = F.split(key, "\\|", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("s"), F.get(parts, F.lit(1)).alias("p"), F.get(parts, F.lit(2)).alias("o"))


def task_id(root: Column, s: Column, p: Column, kind: Column, label: str = "1hop") -> Column:
    """PRJ-4: the object is not part of it, so it names a question group, not a row."""
    value = lambda c, default: F.coalesce(c, F.lit(default))
    who = value(s, "unknown")
    return F.concat(F.lit(f"{label}-"), value(root, "Thing"), F.lit("_"), who, F.lit("-"), who, F.lit("-"), value(p, "unknown"), F.lit("-"), kind)


def _iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def _predicate(p: Column) -> Column:
    return F.when(p == TYPE, p).otherwise(_iri(p))


def task_type(p: Column) -> Column:
    return F.when(p == TYPE, "Membership").otherwise("Property Assertion")


def root_of_file(name: Column) -> Column:
    """PRJ-9: a file's name without its ontology extension."""
    return F.regexp_replace(name, r"(?i)\.(ttl|owl|rdf|n3)$", "")


def root_of_classes(types: DataFrame, by: list[str]) -> DataFrame:
    """PRJ-10: the smallest named class other than Thing of each graph, Thing where there is none."""
    return types.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("c") != "Thing", F.col("c"))), F.lit("Thing")).alias("root_entity"))


def inferences(f) -> DataFrame:
    """EXP-42: (root, s, p, o) of all entailed types and relations; the root is the subject's table here."""
    t = f.typ.select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o")).unionByName(f.rel.select("s", "p", "o"))
    return t.select(F.split("s", "/")[0].alias("root"), "s", "p", "o")


def ask(inf: DataFrame, label: str = "1hop", *more: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One BIN row for each inference (PRJ-6, PRJ-8); ``more`` and ``keep`` are columns that stay."""
    return inf.select(
        task_id(F.col("root"), F.col("s"), F.col("p"), F.lit("BIN"), label).alias("task_id"), F.col("root").alias("root_entity"), task_type(F.col("p")).alias("task_type"), F.lit("BIN").alias("answer_type"),
        F.concat(F.lit("ASK WHERE { "), _iri(F.col("s")), F.lit(" "), _predicate(F.col("p")), F.lit(" "), _iri(F.col("o")), F.lit(" }")).alias("sparql_query"), F.col("p").alias("predicate"), F.lit("TRUE").alias("answer"), *more, *keep,
    )


def select_query(s: Column, p: Column) -> Column:
    """The query for all objects of a subject and property."""
    return F.concat(F.lit("SELECT ?x WHERE { "), _iri(s), F.lit(" "), _predicate(p), F.lit(" ?x }"))


def select_(inf: DataFrame, label: str = "1hop", more: DataFrame | None = None) -> DataFrame:
    """One MC row for each (root, s, p) with several objects, its answers sorted (AGG-3); ``more`` adds its columns by (root, s, p)
    and leaves out what it does not have."""
    many = inf.groupBy("root", "s", "p").agg(F.array_sort(F.collect_set("o")).alias("os")).where("size(os) > 1")
    many = many if more is None else many.join(more, ["root", "s", "p"])
    return many.select(
        task_id(F.col("root"), F.col("s"), F.col("p"), F.lit("MC"), label).alias("task_id"), F.col("root").alias("root_entity"), task_type(F.col("p")).alias("task_type"), F.lit("MC").alias("answer_type"),
        select_query(F.col("s"), F.col("p")).alias("sparql_query"), F.col("p").alias("predicate"), F.array_join("os", "; ").alias("answer"), *([] if more is None else [c for c in more.columns if c not in ("root", "s", "p")]),
    )


def build_query(s: Column, p: Column, o: Column, form: str = "ASK") -> Column:
    """PRJ-7: null parts are variables, rdf:type is ``a``, an http object is an IRI, any other a literal."""
    term = lambda c, v: F.when(c.isNull(), F.lit(v)).otherwise(_iri(c))
    pred = F.when(p.isNull(), F.lit("?p")).when(p == TYPE, F.lit("a")).otherwise(_iri(p))
    obj = F.when(o.isNull(), F.lit("?o")).when(o.startswith("http://") | o.startswith("https://"), _iri(o)).otherwise(F.concat(F.lit('"'), o, F.lit('"')))
    body = F.concat(F.lit("{ "), term(s, "?s"), F.lit(" "), pred, F.lit(" "), obj, F.lit(" }"))
    names = F.array_join(F.array_compact(F.array(F.when(s.isNull(), F.lit("?s")), F.when(p.isNull(), F.lit("?p")), F.when(o.isNull(), F.lit("?o")))), " ")
    return F.concat(F.lit("ASK "), body) if form == "ASK" else F.concat(F.lit("SELECT "), F.when(names == "", F.lit("*")).otherwise(names), F.lit(" WHERE "), body)


def first_seen(rows: DataFrame, key: str, rank: str, graph: str) -> DataFrame:
    """AGG-4: each key with the graph of lowest rank that shows it; minima are combined before the shuffle."""
    return rows.groupBy(key).agg(F.min(F.struct(rank, graph)).alias("m")).select(key, F.col(f"m.{graph}").alias(graph))


def task_ids(rows: DataFrame) -> DataFrame:
    """AGG-5: the sorted task ids of each triple."""
    return rows.groupBy("triple_key").agg(F.array_sort(F.collect_set("task_id")).alias("task_ids"))
