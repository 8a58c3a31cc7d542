"""Ontology files as triples (SRC-1 .. SRC-6): Turtle (with N3's common part) and RDF/XML.

Files are read by Spark's binary reader, so any store Spark knows will do, and parsed one by one on the executors.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.names import short_form
from quillon.operators.model import Expression, Graph, Schema

RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
EXTENSIONS = ("owl", "ttl", "rdf", "n3")
TRIPLES = "graph_id string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, _error string"


@dataclass(frozen=True)
class Term:
    value: str
    kind: str  # iri, bnode or literal
    datatype: str | None = None
    lang: str | None = None


Triple = tuple[Term, str, Term]

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<prefix>@prefix\b|@base\b|PREFIX\b|BASE\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:]))|(?P<bnode>_:[\w\-.]*[\w\-])|(?P<name>[\w\-.]*:(?:[\w\-.:%]|\\.)*(?:[\w\-:%])|[\w\-.]*:)
    |(?P<word>[A-Za-z]+)|(?P<mark>[;,.\[\]()])""",
    re.VERBOSE,
)
_ESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPE.get(m[3], m[3]), text)


def parse_turtle(text: str, graph: str = "g") -> Iterator[Triple]:
    """The triples of a Turtle document; blank nodes are named after the graph and their order."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read {text[at : at + 30]!r} at {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    prefixes: dict[str, str] = {}
    base, i, count, out = "", 0, 0, []

    def fresh() -> Term:
        nonlocal count
        count += 1
        return Term(f"{graph}#b{count}", "bnode")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal i
        if i >= len(tokens):
            raise ValueError("the document ends inside a statement")
        got = tokens[i]
        if value is not None and got[1] != value:
            raise ValueError(f"{value!r} expected, {got[1]!r} found")
        i += 1
        return got

    def iri(kind: str, v: str) -> str:
        if kind == "iri":
            return v[1:-1] if ":" in v or not base else base + v[1:-1]
        head, _, rest = v.partition(":")
        if head not in prefixes:
            raise ValueError(f"unknown prefix {head!r}")
        return prefixes[head] + rest.replace("\\", "")

    def node() -> Term:
        kind, v = take()
        if kind in ("iri", "name"):
            return Term(iri(kind, v), "iri")
        if kind == "bnode":
            return Term(f"{graph}#{v[2:]}", "bnode")
        if v == "[":
            t = fresh()
            if tokens[i][1] != "]":
                statements(t)
            take("]")
            return t
        if v == "(":
            items = []
            while tokens[i][1] != ")":
                items.append(node())
            take(")")
            head = Term(RDF + "nil", "iri")
            for item in reversed(items):
                t = fresh()
                out.append((t, RDF + "first", item))
                out.append((t, RDF + "rest", head))
                head = t
            return head
        if kind in ("string", "long"):
            value = _plain(v[3:-3] if kind == "long" else v[1:-1])
            if i < len(tokens) and tokens[i][0] == "lang":
                return Term(value, "literal", RDF + "langString", take()[1][1:].lower())
            if i < len(tokens) and tokens[i][0] == "type":
                take()
                return Term(value, "literal", iri(*take()))
            return Term(value, "literal", XSD + "string")
        if kind == "number":
            return Term(v, "literal", XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"))
        if v in ("true", "false"):
            return Term(v, "literal", XSD + "boolean")
        raise ValueError(f"no term: {v!r}")

    def statements(subject: Term) -> None:
        while True:
            kind, v = take()
            predicate = RDF + "type" if v == "a" else iri(kind, v)
            while True:
                out.append((subject, predicate, node()))
                if i < len(tokens) and tokens[i][1] == ",":
                    take()
                    continue
                break
            while i < len(tokens) and tokens[i][1] == ";":
                take()
            if i >= len(tokens) or tokens[i][1] in (".", "]"):
                return
            if tokens[i - 1][1] != ";":
                raise ValueError(f"';' or '.' expected, {tokens[i][1]!r} found")

    while i < len(tokens):
        kind, v = tokens[i]
        if kind == "prefix":
            take()
            if v.lower().endswith("base"):
                base = take()[1][1:-1]
            else:
                name = take()[1][:-1]
                prefixes[name] = iri(*take())
            if v.startswith("@"):
                take(".")
            continue
        subject = node()
        if tokens[i][1] != ".":
            statements(subject)
        take(".")
        yield from out
        out.clear()


def parse_rdf_xml(data: bytes, graph: str = "g") -> Iterator[Triple]:
    """The triples of an RDF/XML document; its internal entities are resolved by the XML parser."""
    root = ET.fromstring(data)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")
    count, out = 0, []
    q = lambda name: f"{{{RDF}}}{name}"
    tag = lambda t: t[1:].replace("}", "", 1) if t.startswith("{") else t

    def fresh() -> Term:
        nonlocal count
        count += 1
        return Term(f"{graph}#b{count}", "bnode")

    def full(v: str) -> str:
        return v if re.match(r"[A-Za-z][\w+.\-]*:", v) else base + v

    def subject(e: ET.Element) -> Term:
        if (v := e.get(q("about"))) is not None:
            return Term(full(v), "iri")
        if (v := e.get(q("ID"))) is not None:
            return Term(f"{base}#{v}", "iri")
        if (v := e.get(q("nodeID"))) is not None:
            return Term(f"{graph}#n{v}", "bnode")
        return fresh()

    def describe(e: ET.Element) -> Term:
        s = subject(e)
        if e.tag != q("Description"):
            out.append((s, RDF + "type", Term(tag(e.tag), "iri")))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/")):
                out.append((s, tag(k), Term(v, "literal", XSD + "string")))
        for c in e:
            p = tag(c.tag)
            kind = c.get(q("parseType"))
            if (v := c.get(q("resource"))) is not None:
                out.append((s, p, Term(full(v), "iri")))
            elif (v := c.get(q("nodeID"))) is not None:
                out.append((s, p, Term(f"{graph}#n{v}", "bnode")))
            elif kind == "Collection":
                head = Term(RDF + "nil", "iri")
                for item in reversed([describe(x) for x in c]):
                    t = fresh()
                    out.extend([(t, RDF + "first", item), (t, RDF + "rest", head)])
                    head = t
                out.append((s, p, head))
            elif kind == "Resource":
                t = fresh()
                for x in c:
                    holder = ET.Element(q("Description"))
                    holder.append(x)
                    for _, p2, o2 in _of(holder):
                        out.append((t, p2, o2))
                out.append((s, p, t))
            elif len(c):
                for x in c:
                    out.append((s, p, describe(x)))
            else:
                lang = c.get("{http://www.w3.org/XML/1998/namespace}lang")
                out.append((s, p, Term(c.text or "", "literal", RDF + "langString" if lang else c.get(q("datatype"), XSD + "string"), lang.lower() if lang else None)))
        return s

    def _of(holder: ET.Element) -> list[Triple]:
        before = len(out)
        describe(holder)
        got = out[before:]
        del out[before:]
        return got

    for e in root if root.tag == q("RDF") else [root]:
        describe(e)
        yield from out
        out.clear()


#: Names of ontology files in any case of letters.
ONTOLOGY_FILES = "*.{[oO][wW][lL],[tT][tT][lL],[rR][dD][fF],[nN]3}"


def parse(data: bytes, name: str) -> Iterator[Triple]:
    graph = re.sub(r"(?i)\.(owl|ttl|rdf|n3)$", "", name)
    head = data[:400].lstrip()
    if name.lower().endswith((".owl", ".rdf")) and (head.startswith(b"<?xml") or head.startswith(b"<rdf") or head.startswith(b"<!")):
        return parse_rdf_xml(data, graph)
    return parse_turtle(data.decode("utf-8-sig"), graph)


def read_rdf(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """TRIPLES of all ontology files of a folder (or one file); a file that cannot be read gives one row with _error.

    A graph is a set: triples repeated within a file come once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in TRIPLES.split(", ")]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = parsed_rows(path.rsplit("/", 1)[-1], content.as_py())
                for k in range(0, len(rows), 50_000):
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows[k : k + 50_000], strict=True)], names=names)

    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern or ONTOLOGY_FILES).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "content").mapInArrow(run, TRIPLES)


# The properties that label an entity, the first that is there.
LABELS = (RDFS + "label", "http://www.w3.org/2004/02/skos/core#prefLabel", "http://purl.org/dc/elements/1.1/title", "http://xmlns.com/foaf/0.1/name", "http://schema.org/name")
# What a restriction says, and the kind of its expression.
RESTRICTIONS = {
    "someValuesFrom": "some", "allValuesFrom": "all", "hasSelf": "self", "hasValue": "value", "minCardinality": "min", "minQualifiedCardinality": "min", "maxCardinality": "max", "maxQualifiedCardinality": "max",
    "cardinality": "exact", "qualifiedCardinality": "exact",
}
_CHARACTERS = {
    "SymmetricProperty": "symmetric", "TransitiveProperty": "transitive", "FunctionalProperty": "functional", "InverseFunctionalProperty": "inverse_functional", "ReflexiveProperty": "reflexive",
    "IrreflexiveProperty": "irreflexive", "AsymmetricProperty": "asymmetric",
}


def local(iri: str) -> str:
    return re.split(r"[#/]", iri)[-1] or iri


def schema_of(rows: list[tuple[str, str, str, str]]) -> Schema:
    """The schema of schema triples (s, s_kind, p, o), names as local names; class expressions by their node ids."""
    by: dict[str, dict[str, list[str]]] = {}
    for s, _, p, o in rows:
        by.setdefault(s, {}).setdefault(p, []).append(o)
    nodes = {s for s, k, _, _ in rows if k == "bnode"}
    name = lambda x: x if x in nodes else local(x)

    def listed(head: str) -> list[str]:
        out = []
        while head in by and RDF + "first" in by[head]:
            out.append(by[head][RDF + "first"][0])
            head = by[head][RDF + "rest"][0]
        return out

    s = Schema()
    for n in sorted(nodes):
        f = by[n]
        for key, kind in (("intersectionOf", "and"), ("unionOf", "or")):
            if OWL + key in f:
                s.expressions[n] = Expression(kind, tuple(name(x) for x in listed(f[OWL + key][0])))
        if OWL + "complementOf" in f:
            s.expressions[n] = Expression("not", (name(f[OWL + "complementOf"][0]),))
        if OWL + "onProperty" in f:
            prop = name(f[OWL + "onProperty"][0])
            filler = next((name(f[OWL + k][0]) for k in ("someValuesFrom", "allValuesFrom", "onClass", "hasValue") if OWL + k in f), None)
            kind = next((v for k, v in RESTRICTIONS.items() if OWL + k in f), None)
            count = next((int(f[OWL + k][0]) for k in RESTRICTIONS if k.lower().endswith("cardinality") and OWL + k in f), None)
            if kind:
                s.expressions[n] = Expression(kind, (), prop, filler, count)
    for x in sorted(by):
        f = by[x]
        pairs = ((RDFS + "subClassOf", s.subclass), (OWL + "equivalentClass", s.equivalent), (OWL + "disjointWith", s.disjoint), (RDFS + "subPropertyOf", s.subproperty), (OWL + "equivalentProperty", s.equivalent_property), (OWL + "propertyDisjointWith", s.disjoint_property), (OWL + "inverseOf", s.inverse), (RDFS + "domain", s.domain), (RDFS + "range", s.range))
        for p, to in pairs:
            to.extend((name(x), name(o)) for o in f.get(p, ()))
        for o in f.get(RDF + "type", ()):
            if (kind := _CHARACTERS.get(local(o))) and o.startswith(OWL):
                getattr(s, kind).append(name(x))
            if o == OWL + "AllDifferent":
                s.all_different.extend((name(x), name(y)) for k in ("members", "distinctMembers") for h in f.get(OWL + k, ()) for y in listed(h))
            if o == OWL + "AllDisjointClasses":
                s.disjoint_groups.extend((x, tuple(name(y) for y in listed(h))) for h in f.get(OWL + "members", ()))
        s.chains.extend((tuple(name(y) for y in listed(h)), name(x)) for h in f.get(OWL + "propertyChainAxiom", ()))
        s.keys.extend((name(x), tuple(name(y) for y in listed(h))) for h in f.get(OWL + "hasKey", ()))
        for key in ("intersectionOf", "unionOf", "disjointUnionOf"):
            if OWL + key in f and x not in nodes:
                ops = tuple(name(y) for y in listed(f[OWL + key][0]))
                s.expressions[f"_{key}_{name(x)}"] = Expression("and" if key == "intersectionOf" else "or", ops)
                s.equivalent.append((name(x), f"_{key}_{name(x)}"))
                if key == "disjointUnionOf":
                    s.disjoint_groups.append((x, ops))
    return s


def is_schema(p: Column) -> Column:
    return p.startswith(OWL) | p.startswith(RDFS) | p.startswith(RDF)


def graph_of(triples: DataFrame) -> Graph:
    """One ontology of all triples, with local names: the schema (bounded by the vocabulary) is gathered, the facts stay rows.

    Facts are types by classes that are not OWL's own, and statements between resources by properties of no standard
    vocabulary; annotations and data values are no facts here.  ValueError if two names have the same local name;
    ``graphs.graphs_of`` keeps whole names, and the files apart.
    """
    ok = triples.where("_error is null")
    builtin = F.col("o").startswith(OWL)
    standard = lambda c: is_schema(c) | c.startswith(XSD)
    terms = [ok.where((F.col(k) == "iri") & ~standard(F.col(v))).select(F.col(v).alias("iri")) for v, k in (("s", "s_kind"), ("o", "o_kind"))] + [ok.where(~standard(F.col("p"))).select(F.col("p").alias("iri"))]
    met = terms[0].union(terms[1]).union(terms[2]).groupBy(short_form(F.col("iri")).alias("name")).agg(F.min("iri").alias("a"), F.max("iri").alias("b")).where("a <> b").first()
    if met:
        raise ValueError(f"{met['a']} and {met['b']} are both {met['name']}")
    tbox = ok.where(is_schema(F.col("p")) & ~((F.col("p") == RDF + "type") & (~builtin | (F.col("o") == OWL + "NamedIndividual"))) & ~F.col("p").isin(RDFS + "label", RDFS + "comment"))
    rows = [tuple(r) for r in tbox.select("s", "s_kind", "p", "o").distinct().collect()]
    types = ok.where((F.col("p") == RDF + "type") & (F.col("o_kind") == "iri") & ~builtin & (F.col("s_kind") == "iri")).select(short_form(F.col("s")).alias("s"), short_form(F.col("o")).alias("c")).distinct()
    rel = ok.where(~is_schema(F.col("p")) & (F.col("o_kind") == "iri") & (F.col("s_kind") == "iri")).select(short_form(F.col("s")).alias("s"), short_form(F.col("p")).alias("p"), short_form(F.col("o")).alias("o")).distinct()
    between = ok.where((F.col("o_kind") == "iri") & (F.col("s_kind") == "iri"))
    a, b = short_form(F.col("s")), short_form(F.col("o"))
    same = between.where(F.col("p") == OWL + "sameAs").select(a.alias("a"), b.alias("b")).distinct()
    apart = between.where(F.col("p") == OWL + "differentFrom").select(F.concat_ws("|", a, b).alias("axiom"), F.explode(F.array(a, b)).alias("s")).distinct()
    return Graph(types, rel, schema_of(rows), same, apart)


def labels_of(triples: DataFrame) -> DataFrame:
    """JN-15: (entity, text), the first label of each entity by the order of LABELS, then by text; cleaned by the caller."""
    rank = F.coalesce(*[F.when(F.col("p") == p, F.lit(k)) for k, p in enumerate(LABELS)])
    found = triples.where(F.col("_error").isNull() & F.col("p").isin(*LABELS) & (F.col("o") != ""))
    return found.groupBy(F.col("s").alias("entity")).agg(F.min(F.struct(rank.alias("rank"), F.col("o").alias("text"))).alias("m")).select("entity", "m.text")


def parsed_rows(name: str, content: bytes) -> list[tuple]:
    """The rows of TRIPLES of one file: its distinct triples, or one row with the error if it cannot be read."""
    graph = re.sub(r"(?i)\.(owl|ttl|rdf|n3)$", "", name)
    try:
        return [(graph, s.value, s.kind, p, o.value, o.kind, o.datatype, o.lang, None) for s, p, o in dict.fromkeys(parse(content, name))]
    except (ValueError, ET.ParseError, UnicodeDecodeError, IndexError) as e:
        return [(graph, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def to_turtle(triples: DataFrame, by: str = "graph_id") -> DataFrame:
    """SNK-1, SNK-5: one Turtle text for each graph, a statement a line, sorted."""
    term = lambda v, k, dt, lang: (
        F.when(k == "iri", F.concat(F.lit("<"), v, F.lit(">"))).when(k == "bnode", F.concat(F.lit("_:"), F.regexp_replace(v, r"[^\w]", "_")))
        .otherwise(F.concat(F.lit('"'), F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.coalesce(F.concat(F.lit("@"), lang), F.concat(F.lit("^^<"), dt, F.lit(">")), F.lit(""))))
    )
    none = F.lit(None).cast("string")
    line = F.concat(term(F.col("s"), F.col("s_kind"), none, none), F.lit(" <"), F.col("p"), F.lit("> "), term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang")), F.lit(" ."))
    return triples.where("_error is null").groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("turtle"))



def module_turtle(modules: DataFrame, about: str, comment: str, version: str, by: str = "graph_id") -> DataFrame:
    """SNK-1: Turtle of extracted modules (TRIPLES), each with its ontology head: label, comment and version.

    ``about`` may hold {} for the module's name.
    """
    head = F.concat(F.lit("<http://example.org/extracted/"), F.col(by), F.lit("> "))
    quoted = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)  # noqa: E731  a JSON string is a Turtle string
    label = F.replace(F.lit(about), F.lit("{}"), F.col(by))
    lines = [F.concat(head, F.lit(f"<{RDF}type> <{OWL}Ontology> .")), F.concat(head, F.lit(f"<{RDFS}label> "), quoted(label), F.lit("@en .")), F.concat(head, F.lit(f"<{RDFS}comment> "), quoted(F.lit(comment)), F.lit(" .")), F.concat(head, F.lit(f"<{OWL}versionInfo> "), quoted(F.lit(version)), F.lit(" ."))]
    return to_turtle(modules, by).select(by, F.concat_ws("\n", *lines, "turtle").alias("turtle"))


def write_turtle(texts: DataFrame, path: str, by: str = "graph_id") -> None:
    """SNK-1, SNK-5: a folder for each graph with its Turtle text."""
    texts.select(by, F.col("turtle").alias("value")).write.mode("overwrite").partitionBy(by).text(path)
