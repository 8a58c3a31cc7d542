"""The knowledge-graph model: asserted facts in two narrow tables, the schema part in a driver-side record.

Facts grow with the data and stay DataFrames: ``types`` (s, c) and ``relations`` (s, p, o).  The schema (TBox) is bounded
by the ontology's vocabulary, so its closures are computed on the driver and enter plans as broadcast tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

THING = "Thing"


@dataclass(frozen=True)
class Expression:
    """An anonymous class: ``and``/``or``/``not`` over operands, or ``some``/``all``/``self``/``value`` or a bound
    (``min``/``max``/``exact`` of ``n``) on a property; the filler of ``value`` is an individual."""

    kind: str
    operands: tuple[str, ...] = ()
    prop: str | None = None
    filler: str | None = None
    n: int | None = None


@dataclass
class Schema:
    """Axioms without individuals.  Class positions may name a class or the id of an expression."""

    subclass: list[tuple[str, str]] = field(default_factory=list)
    equivalent: list[tuple[str, str]] = field(default_factory=list)
    disjoint: list[tuple[str, str]] = field(default_factory=list)
    subproperty: list[tuple[str, str]] = field(default_factory=list)
    equivalent_property: list[tuple[str, str]] = field(default_factory=list)
    disjoint_property: list[tuple[str, str]] = field(default_factory=list)
    inverse: list[tuple[str, str]] = field(default_factory=list)
    domain: list[tuple[str, str]] = field(default_factory=list)
    range: list[tuple[str, str]] = field(default_factory=list)
    symmetric: list[str] = field(default_factory=list)
    transitive: list[str] = field(default_factory=list)
    functional: list[str] = field(default_factory=list)
    inverse_functional: list[str] = field(default_factory=list)
    reflexive: list[str] = field(default_factory=list)
    irreflexive: list[str] = field(default_factory=list)
    asymmetric: list[str] = field(default_factory=list)
    chains: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    keys: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    expressions: dict[str, Expression] = field(default_factory=dict)
    #: Groups of individuals that are asserted to be pairwise different, by the node of their axiom.
    all_different: list[tuple[str, str]] = field(default_factory=list)
    #: Groups of classes that are pairwise disjoint, by the node of their axiom; never written as their pairs.
    disjoint_groups: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    def named(self, c: str) -> bool:
        return c not in self.expressions

    def class_edges(self) -> set[tuple[str, str]]:
        """Direct (sub, super) steps: subclass axioms and both directions of equivalences."""
        return set(self.subclass) | set(self.equivalent) | {(b, a) for a, b in self.equivalent}

    def property_steps(self) -> set[tuple[str, str, bool]]:
        """Direct steps (P, Q, swapped): a P fact gives a Q fact, with its ends swapped or not."""
        steps = {(a, b, False) for a, b in self.subproperty}
        steps |= {(a, b, False) for a, b in self.equivalent_property} | {(b, a, False) for a, b in self.equivalent_property}
        steps |= {(a, b, True) for a, b in self.inverse} | {(b, a, True) for a, b in self.inverse}
        return steps | {(p, p, True) for p in self.symmetric}


def closed(steps: set[tuple]) -> set[tuple]:
    """Transitive closure of (a, b) or (a, b, swapped) steps, composed by exclusive or; cycles end by the visited set."""
    by: dict[str, set[tuple[str, bool]]] = {}
    for s in steps:
        by.setdefault(s[0], set()).add((s[1], bool(s[2]) if len(s) > 2 else False))
    out = set()
    for start in by:
        seen, front = set(), [(start, False)]
        while front:
            at, turned = front.pop()
            for nxt, swap in by.get(at, ()):
                if (got := (nxt, turned ^ swap)) not in seen:
                    seen.add(got)
                    front.append(got)
        out |= {(start, b, t) for b, t in seen}
    pairs = len(next(iter(steps), (0, 0))) == 2
    return {(a, b) for a, b, _ in out} if pairs else out


def chain_paths(edges: set[tuple[str, str]], most: int) -> list[tuple[str, str, list[str]]]:
    """All cycle-free paths (from, to, nodes) of at most ``most`` nodes, shortest first, ties by the nodes' names."""
    by: dict[str, list[str]] = {}
    for a, b in edges:
        by.setdefault(a, []).append(b)
    found, front = [], [[a] for a in sorted(by)]
    while front:
        grown = [[*p, b] for p in front for b in sorted(by.get(p[-1], ())) if b not in p and len(p) < most]
        found += [(p[0], p[-1], p) for p in grown]
        front = grown
    return found


def _plain(value, kind: pa.DataType):
    """Tuples of structs by their field names, as Arrow wants them."""
    if pa.types.is_struct(kind) and isinstance(value, tuple):
        return {f.name: _plain(v, f.type) for f, v in zip(kind, value, strict=True)}
    if pa.types.is_list(kind) and value is not None:
        return [_plain(v, kind.value_type) for v in value]
    return value


@dataclass
class Graph:
    """Facts and schema; ``same`` has asserted equalities (a, b), ``different`` members of groups (axiom, s) all apart."""

    types: DataFrame
    relations: DataFrame
    schema: Schema
    same: DataFrame | None = None
    different: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.types.sparkSession

    def table(self, name: str) -> DataFrame:
        """A table of the schema by its name in ``schema_tables``; an axiom told twice is one row."""
        from quillon.operators.schema_tables import TABLES

        ddl, rows = TABLES[name]
        return self.small({repr(r): r for r in rows(self.schema)}.values(), ddl)

    def has(self, *names: str) -> bool:
        """Whether one of the schema's tables or characteristics has a row."""
        from quillon.operators.schema_tables import CHARACTERISTICS, TABLES

        return any(getattr(self.schema, n) if n in CHARACTERISTICS else TABLES[n][1](self.schema) for n in names)

    def having(self, relations: DataFrame, kind: str) -> DataFrame:
        """The relations whose property is of that kind."""
        return relations.where(F.col("p").isin(getattr(self.schema, kind)))

    def reflexives(self, individuals: DataFrame) -> DataFrame:
        """(s, p): each individual with each reflexive property of its graph."""
        return individuals.select("s", F.explode(F.array(*[F.lit(p) for p in self.schema.reflexive])).alias("p"))

    def anonymous(self, c: Column) -> Column:
        """Whether a class is an expression."""
        return c.isin(list(self.schema.expressions))

    def moving(self, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Relations whose properties stand in steps, chains or transitive axioms, and the others."""
        s = self.schema
        active = sorted({p for p, _, _ in s.property_steps()} | {p for links, _ in s.chains for p in links} | set(s.transitive))
        return relations.where(F.col("p").isin(active)), relations.where(~F.col("p").isin(active))

    def derived_properties(self) -> DataFrame:
        """(p): properties of facts that chains, transitive axioms and the steps after these derive."""
        s = self.schema
        made = set(s.transitive) | {target for _, target in s.chains}
        return self.small(sorted((p,) for p in made | {q for p, q, _ in closed(s.property_steps()) if p in made}), "p string")

    def derived_classes(self) -> DataFrame:
        """(c): classes that class expressions derive, and all above them."""
        s = self.schema
        made = set(s.expressions) | {o for e in s.expressions.values() for o in (*e.operands, e.filler) if o}
        return self.small(sorted((c,) for c in made | {b for a, b in closed(s.class_edges()) if a in made}), "c string")

    def used(self, relations: DataFrame) -> DataFrame:
        """Relations whose properties stand in class expressions."""
        return relations.where(F.col("p").isin(sorted({e.prop for e in self.schema.expressions.values() if e.prop})))

    def small(self, rows, ddl: str) -> DataFrame:
        """A schema-sized table, to be broadcast; as a local relation, so that no job runs for it."""
        kinds = to_arrow_schema(T._parse_datatype_string(ddl))
        rows = [tuple(r) for r in rows]
        names = [f.name for f in kinds]
        arrays = [pa.array([_plain(r[k], kinds.field(k).type) for r in rows], kinds.field(k).type) for k in range(len(names))]
        return F.broadcast(self.spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kinds)))
