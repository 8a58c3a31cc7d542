"""Names of entities: local names, namespaces, full IRIs, labels (PRJ-1 .. PRJ-3, VRB-1 .. VRB-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces of the three standard prefixes.
PREFIXES = {"rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs:": "http://www.w3.org/2000/01/rdf-schema#", "owl:": "http://www.w3.org/2002/07/owl#"}


def short_form(iri: Column) -> Column:
    """After the last # if there is one, else after the last slash, else the whole."""
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def local_name(iri: Column) -> Column:
    """After the last # or slash, whichever comes later; the whole IRI where nothing follows."""
    rest = F.regexp_extract(iri, "[^#/]*$", 0)
    return F.when(rest == "", iri).otherwise(rest)


def first_fragment(iri: Column) -> Column:
    """After the first #, else after the last slash: the form of file names."""
    return F.when(F.contains(iri, F.lit("#")), F.regexp_replace(iri, "^[^#]*#", "")).otherwise(F.substring_index(iri, "/", -1))


def namespace(iri: Column) -> Column:
    """Up to and with the last # or slash; empty if there is neither."""
    return F.regexp_extract(iri, "^(.*[#/])", 1)


def full_iri(name: Column, base: str) -> Column:
    """Standard prefixes expanded, IRIs as they are, other names in the base namespace."""
    out = F.when(name.startswith("http://") | name.startswith("https://"), name)
    for prefix, iri in PREFIXES.items():
        out = out.when(name.startswith(prefix), F.concat(F.lit(iri), F.substring(name, len(prefix) + 1, 100_000)))
    return out.otherwise(F.concat(F.lit(base), name))


def file_name(types: Column, individual: Column, most: int = 100) -> Column:
    """SNK-1: up to two types (Thing if none) and the individual, cut and made safe for file systems."""
    head = F.when(F.size(types) == 0, F.lit("Thing")).otherwise(F.array_join(F.slice(F.array_sort(types), 1, 2), "_"))
    return F.substring(F.regexp_replace(F.concat(head, F.lit("_"), individual), "[^a-zA-Z0-9._-]", "_"), 1, most)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))


def entity_label(name: Column) -> Column:
    """VRB-1: trailing years and short suffixes go, camel case and separators become blanks, words get capitals."""
    n = F.regexp_replace(name, "_[0-9]{4}$", "")
    n = F.regexp_replace(n, "_[A-Za-z0-9]{2,3}$", "")
    n = F.regexp_replace(n, "([a-z])([A-Z])", "$1 $2")
    n = F.trim(F.regexp_replace(n, "[_\\-\\s]+", " "))
    return F.array_join(F.transform(F.split(n, " "), _capital), " ")


def property_words(name: Column) -> Column:
    """VRB-2: a property's name as lower-case words."""
    n = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[_\\-\\s]+", " ")
    return F.trim(F.lower(n))


def pattern(name: Column, functional: Column, symmetric: Column, transitive: Column) -> Column:
    """VRB-3: which sentence a property takes."""
    w = property_words(name)
    return (
        F.when(functional, "functional").when(symmetric, "symmetric").when(transitive, "transitive").when(w.startswith("has "), "has").when(w.rlike("^is .* of$"), "is_of").otherwise("default")
    )


def base_relation(name: Column) -> Column:
    """A property's words without a leading has or is and a trailing of."""
    return F.trim(F.regexp_replace(F.regexp_replace(property_words(name), "^(?:has|is) ", ""), " of$", ""))


def sentence(kind: Column, name: Column, s: Column, o: Column) -> Column:
    """VRB-4: one statement as a sentence without its full stop."""
    w, base = property_words(name), base_relation(name)
    return (
        F.when(kind == "functional", F.concat(s, F.lit(" has exactly one "), base, F.lit(" "), o))
        .when(kind == "symmetric", F.concat(s, F.lit(" and "), o, F.lit(" are mutually "), base))
        .when(kind == "transitive", F.concat(s, F.lit(" "), base, F.lit(" "), o))
        .when(kind == "has", F.concat(s, F.lit(" has "), F.regexp_replace(w, "^has ", ""), F.lit(" "), o))
        .when(kind == "is_of", F.concat(s, F.lit(" is "), base, F.lit(" of "), o))
        .otherwise(F.concat(s, F.lit(" "), w, F.lit(" "), o))
    )


def and_list(items: Column) -> Column:
    """A; A and B; A, B and C."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(items, n - 1)))


def oxford_list(items: Column) -> Column:
    """VRB-5: as and_list, with a comma before the last of three or more."""
    n = F.size(items)
    return F.when(n <= 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.get(items, n - 1)))
