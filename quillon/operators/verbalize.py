"""Text from graphs (VRB-5 .. VRB-15).

Class and property descriptions come from the schema, which the driver holds; individuals are described set at a time.
Sentences are ordered by section, property and object.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.operators.model import Schema

# Fixed values throughout this module: the parts of sentences and the keys of documents, which results must share.
#: Incoming statements beyond this many subjects are left out of a description.
MOST_INCOMING = 5
BOUNDS = {"min": "at least", "max": "at most", "exact": "exactly"}


def label(name: str) -> str:
    """A name's words with capitals: the driver-side form of ``entity_label`` for schema names."""
    spaced = re.sub(r"[_\-\s]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", name)).strip()
    return " ".join(w[:1].upper() + w[1:].lower() for w in spaced.split(" "))


def words(name: str) -> str:
    return re.sub(r"[_\-\s]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", name)).strip().lower()


def listed(items: list[str]) -> str:
    return items[0] if len(items) == 1 else ", ".join(items[:-1]) + " and " + items[-1]


def classes(s: Schema) -> dict[str, str]:
    """VRB-6, VRB-7: a description of every named class."""
    out = {}
    pairs = [*s.subclass, *s.equivalent, *s.disjoint]
    names = sorted({c for p in pairs for c in p if s.named(c)} | {c for _, c in [*s.domain, *s.range]})
    for c in names:
        said = [f"{label(c)} is a type of {label(d)}." for d in sorted(b for a, b in s.subclass if a == c and s.named(b))]
        same = sorted({b if a == c else a for a, b in s.equivalent if c in (a, b)})
        said += [f"{label(c)} is equivalent to {label(d)}." for d in same if s.named(d)]
        for d in same:
            e = s.expressions.get(d)
            if e and e.kind in ("some", "all"):
                how = {"some": "some", "all": "only"}[e.kind]
                said.append(f"{label(c)} is defined as a class that has {how} '{words(e.prop or '')}' relationship with an instance of {label(e.filler or 'Thing')}.")
            elif e and e.kind in BOUNDS:
                said.append(f"{label(c)} is defined as a class that has {BOUNDS[e.kind]} {e.n} '{words(e.prop or '')}' relationship(s) with an instance of {label(e.filler or 'Thing')}.")
            elif e and e.kind == "value":
                said.append(f"{label(c)} is defined as a class that has '{words(e.prop or '')}' relationship with {label(e.filler or '')}.")
        apart = sorted(b if a == c else a for a, b in s.disjoint if c in (a, b))
        if apart:
            said.append(f"{label(c)} is disjoint with {listed([label(d) for d in apart])}.")
        props = sorted(words(p) for p, d in s.domain if d == c)[:3]
        if props:
            said.append(f"Instances of {label(c)} can have {listed(props)} relationships.")
        out[c] = " ".join(said) or f"{label(c)} is a class in this ontology."
    return out


def properties(s: Schema) -> dict[str, str]:
    """VRB-9, VRB-10: a description of every property."""
    names = {p for p, _ in [*s.domain, *s.range]} | {p for x in [*s.subproperty, *s.inverse, *s.equivalent_property] for p in x} | {*s.symmetric, *s.transitive, *s.functional} | {t for _, t in s.chains}
    out = {}
    for p in sorted(names):
        said = [f"{label(p)} is a kind of {words(q)}." for q in sorted(b for a, b in s.subproperty if a == p)]
        said += [f"{label(p)} follows from {' and then '.join(words(x) for x in links)}." for links, t in s.chains if t == p]
        for name, of in (("functional", s.functional), ("inverse functional", s.inverse_functional), ("symmetric", s.symmetric), ("asymmetric", s.asymmetric), ("transitive", s.transitive), ("irreflexive", s.irreflexive)):
            if p in of:
                said.append(f"{label(p)} is {name}.")
        said += [f"{label(p)} is the inverse of {words(q)}." for q in sorted(b if a == p else a for a, b in s.inverse if p in (a, b))]
        said += [f"{label(p)} is equivalent to {words(q)}." for q in sorted(b if a == p else a for a, b in s.equivalent_property if p in (a, b))]
        said += [f"{label(p)} is disjoint with {words(q)}." for q in sorted(b if a == p else a for a, b in s.disjoint_property if p in (a, b))]
        d, r = [c for q, c in s.domain if q == p], [c for q, c in s.range if q == p]
        if d and r:
            said.append(f"{label(p)} relates {label(d[0])} to {label(r[0])}.")
        elif d:
            said.append(f"{label(p)} applies to {label(d[0])}.")
        elif r:
            said.append(f"{label(p)} leads to {label(r[0])}.")
        out[p] = " ".join(said) or f"{label(p)} is a property in this ontology."
    return out


# -- descriptions of vocabularies of any size --------------------------------------------------------------------------

_FIRST_PROPERTIES = 3


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), r"[_\-\s]+", " "))


def label_of(c: Column) -> Column:
    """``label`` as a column."""
    return F.array_join(F.transform(F.split(_spaced(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")


def words_of(c: Column) -> Column:
    return F.lower(_spaced(c))


def _said(parts: list[DataFrame], names: DataFrame, nothing: str) -> DataFrame:
    """(graph_id, name, label, description): the sentences of each name by section and their order there, or that it is
    there.  Sentences are gathered for one name at a time, so no vocabulary is too large."""
    rows = reduce(DataFrame.unionByName, [p.select("graph_id", "name", F.lit(k).alias("section"), "key", "text") for k, p in enumerate(parts)])
    told = rows.groupBy("graph_id", "name").agg(F.array_sort(F.collect_set(F.struct("section", "key", "text"))).alias("t"))
    named = names.where("name is not null").distinct().join(told, ["graph_id", "name"], "left").withColumn("label", label_of(F.col("name")))
    return named.select("graph_id", "name", "label", F.coalesce(F.array_join(F.transform("t", lambda x: x["text"]), " "), F.concat("label", F.lit(nothing))).alias("description"))


def _kind(axioms: DataFrame, *kinds: str) -> DataFrame:
    return axioms.where(F.col("kind").isin(*kinds))


def _either(rows: DataFrame) -> DataFrame:
    """(graph_id, name, other) of symmetric axioms, both ways."""
    return rows.select("graph_id", F.col("a").alias("name"), F.col("b").alias("other")).unionByName(rows.select("graph_id", F.col("b").alias("name"), F.col("a").alias("other"))).distinct()


def describe_classes(axioms: DataFrame) -> DataFrame:
    """VRB-6, VRB-7 for axioms as rows (``graphs.AXIOMS``): graph_id, name, label and description of every named class.

    Supers, equivalents and what defines the class, disjoint classes, and the first properties whose domain it is.
    Expressions (names that begin with ``_:``) are described where they define a class.
    """
    c, named = F.col, lambda x: ~F.col(x).startswith("_:")
    me = label_of(c("name"))
    sub = _kind(axioms, "subclass").select("graph_id", c("a").alias("name"), c("b").alias("other"))
    same = _either(_kind(axioms, "equivalent")).where(named("name"))
    groups = _kind(axioms, "disjoint").select("graph_id", "id", c("a").alias("name"))
    apart = groups.join(groups.withColumnRenamed("name", "other"), ["graph_id", "id"]).where("name <> other").where(named("name") & named("other"))
    of = _kind(axioms, "domain").select("graph_id", c("b").alias("name"), c("a").alias("p"))
    ranged = _kind(axioms, "range").select("graph_id", c("b").alias("name"))
    how = F.when(c("kind") == "some", F.lit("some")).when(c("kind") == "all", F.lit("only")).when(c("kind") == "min", F.lit("at least")).when(c("kind") == "max", F.lit("at most")).when(c("kind") == "exact", F.lit("exactly"))
    counted = F.when(c("kind").isin("min", "max", "exact"), F.concat(F.lit(" "), c("n").cast("string"))).otherwise(F.lit(""))
    many = F.when(c("kind").isin("min", "max", "exact"), F.lit("(s)")).otherwise(F.lit(""))
    filler = label_of(F.coalesce(c("b"), F.lit("Thing")))
    defined = F.when(c("kind") == "value", F.concat(me, F.lit(" is defined as a class that has '"), words_of(c("a")), F.lit("' relationship with "), filler, F.lit("."))).otherwise(
        F.concat(me, F.lit(" is defined as a class that has "), how, counted, F.lit(" '"), words_of(c("a")), F.lit("' relationship"), many, F.lit(" with an instance of "), filler, F.lit("."))
    )
    expressions = _kind(axioms, "some", "all", "min", "max", "exact", "value").select("graph_id", c("id").alias("other"), "kind", "a", "b", "n")
    parts = [
        sub.where(named("name") & named("other")).withColumns({"key": c("other"), "text": F.concat(me, F.lit(" is a type of "), label_of(c("other")), F.lit("."))}),
        same.where(named("other")).withColumns({"key": c("other"), "text": F.concat(me, F.lit(" is equivalent to "), label_of(c("other")), F.lit("."))}),
        same.join(expressions, ["graph_id", "other"]).withColumns({"key": c("other"), "text": defined}),
        apart.groupBy("graph_id", "name").agg(F.array_sort(F.collect_set("other")).alias("o")).select("graph_id", "name", F.lit("").alias("key"), F.concat(me, F.lit(" is disjoint with "), N.and_list(F.transform("o", label_of)), F.lit(".")).alias("text")),
        of.groupBy("graph_id", "name").agg(F.slice(F.array_sort(F.collect_set(words_of(c("p")))), 1, _FIRST_PROPERTIES).alias("o")).select("graph_id", "name", F.lit("").alias("key"), F.concat(F.lit("Instances of "), me, F.lit(" can have "), N.and_list(c("o")), F.lit(" relationships.")).alias("text")),
    ]
    names = [r.select("graph_id", "name") for r in (sub, sub.select("graph_id", c("other").alias("name")), same, same.select("graph_id", c("other").alias("name")), groups, of, ranged)]
    return _said(parts, reduce(DataFrame.unionByName, names).where(named("name")), " is a class in this ontology.")


def describe_properties(axioms: DataFrame) -> DataFrame:
    """VRB-9, VRB-10 for axioms as rows: graph_id, name, label and description of every property.

    Of several domains or ranges the smallest name is told.
    """
    c = F.col
    me = label_of(c("name"))
    sub = _kind(axioms, "subproperty").select("graph_id", c("a").alias("name"), c("b").alias("other"))
    chains = _kind(axioms, "chain").groupBy("graph_id", "id", c("b").alias("name")).agg(F.array_sort(F.collect_list(F.struct("at", "a"))).alias("l"))
    kinds = ("functional", "inverse_functional", "symmetric", "asymmetric", "transitive", "irreflexive")
    said = _kind(axioms, *kinds).select("graph_id", c("a").alias("name"), "kind")
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), c("kind")).cast("string")
    inverse, equal, apart = (_either(_kind(axioms, k)) for k in ("inverse", "equivalent_property", "disjoint_property"))
    ends = [_kind(axioms, k).groupBy("graph_id", c("a").alias("name")).agg(F.min("b").alias(k)) for k in ("domain", "range")]
    both = ends[0].join(ends[1], ["graph_id", "name"], "full")
    relates = F.when(c("domain").isNotNull() & c("range").isNotNull(), F.concat(me, F.lit(" relates "), label_of(c("domain")), F.lit(" to "), label_of(c("range")), F.lit("."))).when(c("domain").isNotNull(), F.concat(me, F.lit(" applies to "), label_of(c("domain")), F.lit("."))).otherwise(F.concat(me, F.lit(" leads to "), label_of(c("range")), F.lit(".")))
    other = lambda rows, middle: rows.withColumns({"key": c("other"), "text": F.concat(me, F.lit(middle), words_of(c("other")), F.lit("."))})
    parts = [
        other(sub, " is a kind of "),
        chains.withColumns({"key": c("id"), "text": F.concat(me, F.lit(" follows from "), F.array_join(F.transform("l", lambda x: words_of(x["a"])), " and then "), F.lit("."))}),
        said.withColumns({"key": place, "text": F.concat(me, F.lit(" is "), F.replace(c("kind"), F.lit("_"), F.lit(" ")), F.lit("."))}),
        other(inverse, " is the inverse of "), other(equal, " is equivalent to "), other(apart, " is disjoint with "),
        both.withColumns({"key": F.lit(""), "text": relates}),
    ]
    names = [r.select("graph_id", "name") for r in (sub, sub.select("graph_id", c("other").alias("name")), chains, said, inverse, equal, apart, both)]
    return _said(parts, reduce(DataFrame.unionByName, names), " is a property in this ontology.")


def vocabulary_text(axioms: DataFrame) -> DataFrame:
    """SNK-12 for axioms as rows: (graph_id, section, name, line), the lines of the schema's text, sorted by section and name."""
    of = lambda rows, section: rows.select("graph_id", F.lit(section).alias("section"), "name", F.col("description").alias("line"))
    return of(describe_classes(axioms), "0 classes").unionByName(of(describe_properties(axioms), "1 properties"))


def discover(types: DataFrame, relations: DataFrame) -> DataFrame:
    """VRB-11: (s) of all individuals: typed, or an end of a relation."""
    return types.select("s").unionByName(relations.select("s")).unionByName(relations.select(F.col("o").alias("s"))).distinct()


def individuals(types: DataFrame, relations: DataFrame, s: Schema, label=N.entity_label, incoming: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """VRB-12: s, label and description of every individual.

    Types first, then outgoing statements by property, then incoming ones of properties that do not go out: one subject
    in the property's own sentence, up to MOST_INCOMING listed, more left out.  Incoming subjects are counted before any
    are gathered, so a hub gathers none.  ``labels`` (entity, text) names individuals where it can (JN-15), else their names do.
    """
    p = F.col("p")
    if labels is None:
        types, relations = types.withColumn("ls", label(F.col("s"))), relations.withColumns({"ls": label(F.col("s")), "lo": label(F.col("o"))})
    else:
        named = labels.select(F.col("entity").alias("_e"), label(F.col("text")).alias("_l"))
        side = lambda rows, of, out: rows.join(named, F.col(of) == F.col("_e"), "left").withColumn(out, F.coalesce("_l", label(F.col(of)))).drop("_e", "_l")
        types, relations = side(types, "s", "ls"), side(side(relations, "s", "ls"), "o", "lo")
    kind = N.pattern(p, p.isin(s.functional) if s.functional else F.lit(False), p.isin(s.symmetric) if s.symmetric else F.lit(False), p.isin(s.transitive) if s.transitive else F.lit(False))
    t = types.groupBy("s", "ls").agg(F.array_sort(F.collect_set("c")).alias("cs")).select("s", F.lit("0").alias("k"), F.concat("ls", F.lit(" is an instance of "), F.array_join("cs", " and ")).alias("t"))
    o = relations.groupBy("s", "ls", "p").agg(F.array_sort(F.collect_set("lo")).alias("os")).select("s", F.concat(F.lit("1"), p).alias("k"), N.sentence(kind, p, F.col("ls"), N.and_list(F.col("os"))).alias("t"))
    parts = t.unionByName(o)
    if incoming:
        into = relations.select(F.col("o").alias("s"), F.col("lo").alias("ls"), "p", F.col("s").alias("y"), F.col("ls").alias("ly")).join(relations.select("s", "p").distinct(), ["s", "p"], "left_anti")
        few = into.groupBy("s", "p").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_INCOMING)
        i = into.join(few, ["s", "p"]).groupBy("s", "ls", "p").agg(F.array_sort(F.collect_set("ly")).alias("ys"))
        one = N.sentence(kind, p, F.get("ys", F.lit(0)), F.col("ls"))
        many = F.concat(N.and_list(F.col("ys")), F.lit(" are related to "), F.col("ls"), F.lit(" through "), N.property_words(p))
        parts = parts.unionByName(i.select("s", F.concat(F.lit("2"), p).alias("k"), F.when(F.size("ys") == 1, one).otherwise(many).alias("t")))
    said = parts.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("ts")).select("s", F.concat(F.array_join(F.transform("ts", lambda q: q["t"]), ". "), F.lit(".")).alias("d"))
    name = types.select("s", "ls").unionByName(relations.select("s", "ls")).unionByName(relations.select(F.col("o").alias("s"), F.col("lo").alias("ls"))).distinct()
    return name.join(said, "s", "left").select("s", F.col("ls").alias("label"), F.coalesce("d", F.concat("ls", F.lit(" is an individual in this ontology."))).alias("description"))


def structural_type(n_subclass: Column, n_properties: Column, n_individuals: Column) -> Column:
    """AGG-21: what an ontology mostly is; the first bound that is passed names it."""
    return F.when(n_subclass > 10, "hierarchical").when(n_properties > 20, "relational").when(n_individuals > 50, "instance_heavy").otherwise("general")


def sections(described: DataFrame, s: Schema) -> DataFrame:
    """VRB-13 for ontologies of any size: (section, label, description), a row each; written as JSON lines in many files."""
    spark = described.sparkSession
    small = [("classes", label(c), d) for c, d in classes(s).items()] + [("objectProperties", label(p), d) for p, d in properties(s).items()]
    return spark.createDataFrame(small, "section string, label string, description string").unionByName(described.select(F.lit("individuals").alias("section"), "label", "description"))


def tbox_text(s: Schema) -> str:
    """SNK-12: the schema as text, a line for each class and property."""
    return "\n".join([*(d for _, d in sorted(classes(s).items())), *(d for _, d in sorted(properties(s).items()))])


def metadata_json(s: Schema) -> str:
    """SNK-12: the metadata file's content."""
    return json.dumps({"metadata": {"verbalized_tbox": tbox_text(s)}}, ensure_ascii=False, indent=2)


def document(name: str, described: DataFrame, s: Schema, triples: int) -> DataFrame:
    """VRB-13: one JSON document of an ontology: classes, properties and individuals sorted by label.

    One row, as the file is one object; ``sections`` has the same content a row an entity, for ontologies too large for that.
    """
    spark = described.sparkSession
    cls = [(label(c), d) for c, d in classes(s).items()]
    prop = [(label(p), d) for p, d in properties(s).items()]
    head = spark.createDataFrame([(name, triples, sorted(cls), sorted(prop))], "name string, triples int, classes array<struct<classLabel:string,description:string>>, objectProperties array<struct<propertyLabel:string,description:string>>")
    people = described.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("individualLabel"), "description"))).alias("individuals"), F.count("*").alias("n"))
    kind = structural_type(F.lit(len(s.subclass)), F.lit(len(prop)), F.col("n"))
    return head.crossJoin(people).select(F.to_json(F.struct(F.struct("name", kind.alias("structuralType"), "triples").alias("ontology"), "classes", "objectProperties", "individuals")).alias("json"))


def context(descriptions: Column) -> Column:
    """VRB-15: the descriptions, a line each."""
    return F.concat(F.array_join(descriptions, "\n"), F.lit("\n"))
