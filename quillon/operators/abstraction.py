"""Abstraction of names (ABS-1 .. ABS-12)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.names import namespace
from quillon.plans.skew import running

BASE = "http://www.example.com/abstracted.owl#"
# Categories by rank, with the stems of their abstract names.
CATEGORIES = {"class": (1, "Class"), "object_property": (2, "Property"), "data_property": (3, "DataProperty"), "individual": (4, "Individual")}
SKIP_WORDS = ("class", "property", "type", "thing")
#: A namespace or prefix counts as the ontology's own if it occurs more often than this.
LEAST_USES = 5


def namespace_mode(iris: DataFrame) -> DataFrame:
    """ABS-1, AGG-20 over IRIs: the commonest namespace, ties by name; mode unknown if none is common."""
    n = iris.select(namespace(F.col("iri")).alias("ns")).groupBy("ns").agg(F.count("*").alias("n"))
    top = n.agg(F.min(F.struct((-F.col("n")).alias("k"), "ns")).alias("m"))
    often = -F.col("m.k") > LEAST_USES
    return top.select(F.when(often, "uri").otherwise("unknown").alias("mode"), F.when(often, F.col("m.ns")).alias("namespace"), (-F.col("m.k")).alias("n"))


def prefix_mode(text: DataFrame, column: str = "text", standard: tuple = ("rdf", "rdfs", "owl", "xsd", "xml")) -> DataFrame:
    """ABS-1 over Turtle text: ``ns1`` if common, else the commonest own prefix, else the commonest namespace of IRIs."""
    used = text.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?<![\w<:/])([A-Za-z][\w\-]*):[A-Za-z_]"), F.lit(1))).alias("p")).where(~F.col("p").isin(*standard, "http", "https"))
    counts = used.groupBy("p").agg(F.count("*").alias("n")).agg(F.max(F.when(F.col("p") == "ns1", F.col("n"))).alias("ns1"), F.min(F.struct((-F.col("n")).alias("k"), "p")).alias("m"))
    iri = text.select(F.explode(F.regexp_extract_all(column, F.lit(r"<([^>]+)>"), F.lit(1))).alias("iri"))
    uri = namespace_mode(iri).select(F.col("mode").alias("um"), F.col("namespace").alias("un"))
    mode = F.when(F.col("ns1") > LEAST_USES, F.struct(F.lit("prefix").alias("mode"), F.lit("ns1").alias("name"))).when(-F.col("m.k") > LEAST_USES, F.struct(F.lit("prefix").alias("mode"), F.col("m.p").alias("name"))).otherwise(F.struct(F.col("um").alias("mode"), F.col("un").alias("name")))
    return counts.crossJoin(uri).select(mode.alias("r")).select("r.*")


def declared(triples: DataFrame) -> DataFrame:
    """ABS-2: (term, category) by rdf:type; annotation properties count as data properties."""
    kind = F.regexp_extract("o", "[^#/]*$", 0)
    cat = F.when(kind == "Class", "class").when(kind == "ObjectProperty", "object_property").when(kind.isin("DatatypeProperty", "AnnotationProperty"), "data_property").when(kind == "NamedIndividual", "individual")
    rows = triples.where((F.col("p").endswith("#type")) & (F.col("s_kind") == "iri")).select(F.regexp_extract("s", "[^#/]*$", 0).alias("term"), cat.alias("category"))
    return rows.where("category is not null").distinct()


# Names of individuals, then of properties (any case, so any name that begins with a letter).
INDIVIDUAL_NAMES = ("^[UPC][0-9]", "^[A-Z][0-9]+$", "[0-9]+$", "_[0-9]+$", r"^Individual\d+$")
PROPERTY_NAMES = ("^(has|is|can|should|get|set)", "(Of|For|By|To|From|With)$", "^(advises|enrolls|teaches|offer|takes)", "^[a-z]")


def heuristic(name: Column) -> Column:
    """ABS-4 on a bare name: individuals, then properties, then classes by a first capital; any other is a property."""
    person = name.rlike("|".join(INDIVIDUAL_NAMES))
    return F.when(person, "individual").when(name.rlike("(?i)" + "|".join(PROPERTY_NAMES)), "object_property").when(name.rlike(r"^\p{Lu}"), "class").otherwise("object_property")


def _own(mode: str, name: str) -> str:
    """A term of the ontology's own namespace or prefix, its local name as the group."""
    return rf"<{re.escape(name)}#([^<>\s]+)>" if mode == "uri" else rf"\b{re.escape(name)}:([A-Za-z][A-Za-z0-9_]*)\b"


def target_terms(files: DataFrame, text: str, mode: str, name: str) -> DataFrame:
    """ABS-3: (term) of all own terms in Turtle texts."""
    return files.select(F.explode(F.regexp_extract_all(text, F.lit(_own(mode, name)), F.lit(1))).alias("term")).distinct()


# What a declaration says, and its category.
DECLARED = (("Class", "class"), ("ObjectProperty", "object_property"), ("(?:DatatypeProperty|AnnotationProperty)", "data_property"), ("NamedIndividual", "individual"))


def _found(text: str, pattern: str, category: str, rank: int = 0) -> Column:
    """(term, k, category) of the terms that a pattern finds."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: F.struct(t.alias("term"), F.lit(rank).alias("k"), F.lit(category).alias("category")))


def declared_in(files: DataFrame, text: str, mode: str, name: str) -> DataFrame:
    """ABS-2 on Turtle texts, for either mode: (term, category) of ``term a owl:Kind`` or ``term rdf:type owl:Kind``."""
    said = r"\s+(?:rdf:type|a)\s+(?:owl:|<http://www\.w3\.org/2002/07/owl#)"
    rows = [_found(text, rf"{_own(mode, name)}{said}{kind}\b", category) for kind, category in DECLARED]
    return files.select(F.explode(F.concat(*rows)).alias("r")).select("r.term", "r.category").distinct()


# Fixed values in the next function: the patterns by which a name's place in a text tells its category.
def structural(files: DataFrame, text: str, name: str) -> DataFrame:
    """ABS-4, the tests of place for prefix mode: (term, category), the first test that a term passes anywhere.

    Classes beside rdfs:subClassOf, properties with a domain or range or between two words, individuals with a type.
    """
    own = rf"{re.escape(name)}:(\w+)"
    tests = ((rf"\b{own}\s+rdfs:subClassOf", "class"), (rf"rdfs:subClassOf\s+{own}\b", "class"), (rf"\b{own}\s+rdfs:(?:domain|range)", "object_property"), (rf"(?<=\w)\s+{own}(?=\s+\w)", "object_property"), (rf"\b{own}\s+(?:rdf:type|a)\s+(?:\w+:|<[^>]*#)[A-Z]", "individual"))
    rows = files.select(F.explode(F.concat(*[_found(text, p, c, k) for k, (p, c) in enumerate(tests)])).alias("r")).select("r.*")
    return rows.groupBy("term").agg(F.min(F.struct("k", "category")).alias("m")).select("term", "m.category")


def categorized(files: DataFrame, text: str, mode: str, name: str) -> DataFrame:
    """ABS-2 .. ABS-4: (term, category) of all own terms: declarations, else places (prefix mode), else names."""
    told = declared_in(files, text, mode, name)
    rest = missed(target_terms(files, text, mode, name), told.select("term"))
    if mode == "prefix":
        rest = rest.join(structural(files, text, name), "term", "left")
    else:
        rest = rest.withColumn("category", F.lit(None).cast("string"))
    return told.unionByName(rest.select("term", F.coalesce("category", heuristic(F.col("term"))).alias("category")))


def resolve(terms: DataFrame) -> DataFrame:
    """ABS-5, ABS-6: one category of each term, classes before properties before individuals; skip words go."""
    rank = F.coalesce(*[F.when(F.col("category") == c, F.lit(r)) for c, (r, _) in CATEGORIES.items()])
    rows = terms.where(~F.lower("term").isin(*SKIP_WORDS) & (F.col("term") != ""))
    return rows.groupBy("term").agg(F.min(rank).alias("rank"))


def mapping(terms: DataFrame) -> DataFrame:
    """ABS-7: original, category, abstract_name and abstract_uri, numbered by name within a category.

    The numbers are running counts over ranges of names, so a category of any size is numbered by all tasks.
    """
    stem = F.coalesce(*[F.when(F.col("rank") == r, F.lit(s)) for r, s in CATEGORIES.values()])
    cat = F.coalesce(*[F.when(F.col("rank") == r, F.lit(c)) for c, (r, _) in CATEGORIES.items()])
    name = F.concat(stem, F.col("_n").cast("string"))
    m = running(resolve(terms), ["rank"], ["term"], "_n").select(F.col("term").alias("original"), cat.alias("category"), name.alias("abstract_name"))
    return m.withColumn("abstract_uri", F.concat(F.lit(BASE), "abstract_name"))


#: Words of a text, and every other character alone.
_TOKENS = r"(?U)\w+|[^\w]"


def _free(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    out = []
    for n in names:
        while n in df.columns:
            n += "_"
        out.append(n)
    return out


#: Up to so many names every task holds them as a trie; more meet the texts' word runs in a join.
TRIE_NAMES = 1 << 17


def trie_of(names: Iterable[tuple[list[str], str]]) -> dict:
    """A trie over tokens; what stands for a name is at the key None of its last node."""
    root: dict = {}
    for tokens, new in names:
        node = root
        for t in tokens:
            node = node.setdefault(t, {})
        node[None] = new
    return root


def walked(tokens: list[str], trie: dict) -> str:
    """The tokens with names replaced: from each place the longest name, then on behind it.

    A place looks no further than the longest name that begins as the text does, so work grows with the text.
    """
    out, i, n = [], 0, len(tokens)
    while i < n:
        node, k, new, end = trie, i, None, i + 1
        while k < n and (node := node.get(tokens[k])) is not None:
            k += 1
            if None in node:
                new, end = node[None], k
        out.append(tokens[i] if new is None else new)
        i = end
    return "".join(out)


def rewrite(df: DataFrame, text: str, m: DataFrame) -> DataFrame:
    """ABS-9 .. ABS-11: names in the text by their abstract names; a null text is empty.

    A name stands where its words and the characters between them stand whole; of names that begin at one place the
    longest counts.  Texts are walked along a trie of the names: of all names up to TRIE_NAMES, else of those that a join of
    the text's distinct word runs finds.  So neither the number of names nor the length of a text bounds it.
    """
    tokens_of = lambda c: F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0))
    names = m.select("original", "abstract_name", tokens_of(F.col("original")).alias("tokens")).where("size(tokens) > 0")
    tok, row, found = _free(df, "_tok", "_row", "_found")
    parts = df.withColumn(tok, tokens_of(F.coalesce(text, F.lit(""))))
    if names.count() <= TRIE_NAMES:
        held = names.select("tokens", "abstract_name").toArrow()  # bounded by TRIE_NAMES
        shared = df.sparkSession.sparkContext.broadcast(list(zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True)))
        return _rewritten(parts, df, text, tok, None, shared)
    sizes = sorted(r[0] for r in names.select(F.size("tokens")).distinct().collect())  # numbers of words in a name
    parts = parts.withColumn(row, F.xxhash64(*parts.columns))
    places = F.sequence(F.lit(0), F.size(tok) - 1)
    run = lambda i, k: F.array_join(F.slice(F.col(tok), i + 1, k), "")  # noqa: E731  k tokens from the i-th, from 0
    runs = F.when(F.size(tok) > 0, F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.array(*[F.lit(k) for k in sizes]), lambda k: run(i, k))))))
    words = parts.select(row, F.explode(runs).alias("original")).distinct().join(names, "original")
    own = words.groupBy(row).agg(F.collect_list(F.struct("tokens", "abstract_name")).alias(found))
    return _rewritten(parts.join(own, row, "left").drop(row), df, text, tok, found, None)


def _rewritten(parts: DataFrame, df: DataFrame, text: str, tok: str, found: str | None, shared) -> DataFrame:
    names, kept = parts.columns, df.columns
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = None if shared is None else trie_of(shared.value)
        for b in batches:
            tokens = b.column(names.index(tok)).to_pylist()
            own = [every] * len(tokens) if found is None else [trie_of((x["tokens"], x["abstract_name"]) for x in f or ()) for f in b.column(names.index(found)).to_pylist()]
            columns = [b.column(names.index(c)) for c in kept]
            columns[at] = pa.array([walked(t or [], trie) for t, trie in zip(tokens, own, strict=True)], pa.string())
            yield pa.record_batch(columns, names=kept)

    return parts.mapInArrow(run, df.schema)


def rewrite_turtle(files: DataFrame, text: str, m: DataFrame, mode: str, name: str) -> DataFrame:
    """ABS-9, ABS-10 on ontology files (a row a file): the own names of a Turtle text by their abstract IRIs.

    mode uri: ``<name#local>`` and comments ``### name#local``; mode prefix: whole ``name:local``; with another mode (no
    namespace is common) nothing changes.  Names without a mapping stay.
    """
    if mode not in ("uri", "prefix"):
        return files
    row, tok, found_map = _free(files, "_row", "_tok", "_map")
    own = re.escape(name)
    pieces = rf"<{own}#[^<>\s]+>|###\s+{own}#[^\s]+" if mode == "uri" else rf"(?<![\w<:/]){own}:[\w\-]+"
    pattern = F.lit(rf"(?s){pieces}|.+?(?={pieces}|\z)")
    rows = files.withColumn(text, F.coalesce(text, F.lit(""))).withColumn(row, F.xxhash64(*files.columns))
    parts = rows.withColumn(tok, F.regexp_extract_all(text, pattern, F.lit(0)))
    whole = rf"(?s)^(?:<|###\s+)?{own}[#:]([^>\s]+)>?$"
    local = lambda t: F.regexp_extract(t, whole, 1)
    words = parts.select(row, F.explode(F.array_distinct(F.transform(tok, local))).alias("original")).distinct().join(m.select("original", "abstract_uri"), "original")
    found = words.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("original", "abstract_uri"))).alias(found_map))

    def said(t: Column) -> Column:
        iri = F.try_element_at(F.col(found_map), local(t))
        return F.when(iri.isNull() | (local(t) == ""), t).when(t.startswith("###"), F.concat(F.lit("###  "), iri)).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))

    return parts.join(found, row, "left").withColumn(text, F.array_join(F.transform(tok, said), "")).select(*files.columns)


def missed(all_terms: DataFrame, typed: DataFrame) -> DataFrame:
    """JN-12: terms that no declaration types."""
    return all_terms.join(typed, "term", "left_anti")


# The sections of a mapping file, by category.
SECTIONS = {"class": "CLASSES", "object_property": "OBJECT PROPERTIES", "data_property": "DATA PROPERTIES", "individual": "INDIVIDUALS"}


def mapping_lines(m: DataFrame) -> DataFrame:
    """SNK-6: the lines of a mapping file: a head for each category that has names, then its names in order."""
    rank = F.coalesce(*[F.when(F.col("category") == c, F.lit(r)) for c, (r, _) in CATEGORIES.items()])
    title = F.coalesce(*[F.when(F.col("category") == c, F.lit(f"=== {t} ===")) for c, t in SECTIONS.items()])
    heads = m.groupBy("category").agg(F.count("*")).select(rank.alias("rank"), F.lit(0).alias("k"), F.lit("").alias("original"), title.alias("line"))
    names = m.select(rank.alias("rank"), F.lit(1).alias("k"), "original", F.concat("original", F.lit(" -> <"), "abstract_uri", F.lit(">")).alias("line"))
    return heads.unionByName(names).orderBy("rank", "k", "original").select("line")
