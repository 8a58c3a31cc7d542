"""The tables that rules and strategies read from a schema, by name, for a schema that the driver holds.

``graphs.py`` has the same tables, derived by joins, for the schemas of many graphs.
"""

from __future__ import annotations

from collections.abc import Callable

from quillon.operators.model import THING, Schema, chain_paths, closed

#: Node limits of the hierarchy searches: traces to assertions, searches over sub- and equivalent classes, and the
#: deep search over subclasses alone.
TRACE_NODES, SEARCH_NODES, DEEP_NODES = 10, 11, 9


def named_edges(s: Schema, equivalents: bool) -> set[tuple[str, str]]:
    edges = s.class_edges() if equivalents else set(s.subclass)
    return {(a, b) for a, b in edges if s.named(a) and s.named(b) and a != b}


def _both(pairs) -> list[tuple[str, str]]:
    return sorted({p for a, b in pairs for p in ((a, b), (b, a))})


def _expressions(s: Schema, kind: str) -> list[tuple]:
    return [(k, e.prop, e.filler) for k, e in s.expressions.items() if e.kind == kind]


def _shortest(edges: set[tuple[str, str]], most: int) -> dict[tuple[str, str], list[str]]:
    best: dict[tuple[str, str], list[str]] = {}
    for a, b, p in chain_paths(edges, most):
        best.setdefault((a, b), p)
    return best


def _search(s: Schema) -> list[tuple]:
    equal = {frozenset(e) for e in s.equivalent}
    rows = []
    for (a, b), p in sorted(_shortest(named_edges(s, True), TRACE_NODES).items()):
        steps = [*zip(p, p[1:], strict=False)]
        words = [f"{x} {'EquivalentTo' if frozenset((x, y)) in equal else 'SubClassOf'} {y}" for x, y in steps]
        rows.append((a, b, words, [("EquivalentClasses" if frozenset((x, y)) in equal else "SubClassOf", [x, y]) for x, y in steps]))
    return rows


def _holders(s: Schema, kind: str, subclass: bool) -> list[tuple[str, str]]:
    """(named class, expression) where the class equals the expression, or (if asked) lies below it."""
    pairs = _both(s.equivalent) + (list(s.subclass) if subclass else [])
    return sorted({(a, b) for a, b in pairs if s.named(a) and not s.named(b) and s.expressions[b].kind == kind})


def _operands(s: Schema, kind: str, subclass: bool) -> list[tuple]:
    """(class, expression, named operand, operands, named operands)"""
    out = []
    for cls, x in _holders(s, kind, subclass):
        ops = s.expressions[x].operands
        named = [o for o in ops if s.named(o)]
        out += [(cls, x, o, len(ops), len(named)) for o in named]
    return out


def _restrictions(s: Schema, kind: str) -> list[tuple]:
    return [(cls, x, s.expressions[x].prop, s.expressions[x].filler) for cls, x in _holders(s, kind, True)]


def _mixed(s: Schema) -> tuple[list[tuple], list[tuple]]:
    """Named operands and existentials of the intersections that have both, by their places."""
    named, some = [], []
    for cls, x in _holders(s, "and", False):
        for k, o in enumerate(s.expressions[x].operands):
            if s.named(o):
                named.append((cls, x, k, o))
            elif s.expressions[o].kind == "some":
                some.append((cls, x, k, s.expressions[o].prop, s.expressions[o].filler))
    mixed = {r[:2] for r in named} & {r[:2] for r in some}
    return [r for r in named if r[:2] in mixed], [r for r in some if r[:2] in mixed]


def _witnessed(s: Schema) -> list[tuple]:
    pairs = sorted((a, b) for a, b in closed(s.class_edges()) if not s.named(b) and s.expressions[b].kind == "some" and s.named(a))
    return [(c, x, s.expressions[x].prop, s.expressions[x].filler) for c, x in pairs]


def _disjoint(s: Schema) -> list[tuple]:
    """(axiom, class, place) of classes apart: pairs, complements and groups; a group stays one axiom."""
    pairs = [*s.disjoint, *((k, e.operands[0]) for k, e in s.expressions.items() if e.kind == "not")]
    return [(f"{n}", c, k) for n, pair in enumerate(dict.fromkeys(pairs)) for k, c in enumerate(pair)] + [(f"group {x}", c, k) for x, cs in s.disjoint_groups for k, c in enumerate(cs)]


_PQ, _CD, _DXPF = "p string, q string", "c string, d string", "d string, x string, p string, f string"

TABLES: dict[str, tuple[str, Callable[[Schema], list[tuple]]]] = {
    "steps": ("p string, q string, swap boolean", lambda s: sorted(closed(s.property_steps()))),
    "subproperty": ("q string, p string", lambda s: list(s.subproperty)),
    "subproperty_closed": (_PQ, lambda s: sorted((a, b) for a, b in closed(set(s.subproperty)) if a != b)),
    "inverse": (_PQ, lambda s: _both(s.inverse)),
    "chains": ("id string, link string, target string, at int, n int", lambda s: [(str(k), p, t, i, len(links)) for k, (links, t) in enumerate(s.chains) for i, p in enumerate(links)]),
    "two_links": ("p1 string, p2 string, t string", lambda s: [(ls[0], ls[1], t) for ls, t in s.chains if len(ls) == 2]),
    "class_closed": (_CD, lambda s: sorted((a, b) for a, b in closed(s.class_edges()) if a != b)),
    "subclass_named": (_CD, lambda s: [(a, b) for a, b in s.subclass if s.named(a) and s.named(b)]),
    "equivalent_named": (_CD, lambda s: [p for a, b in s.equivalent if s.named(a) and s.named(b) for p in ((a, b), (b, a))]),
    "traces": ("c string, d string, nodes array<string>", lambda s: [(a, b, p) for (a, b), p in sorted(_shortest(named_edges(s, False), TRACE_NODES).items())]),
    "searches": ("c string, d string, words array<string>, steps array<struct<kind:string,args:array<string>>>", _search),
    "all_paths": ("c string, d string, nodes array<string>", lambda s: chain_paths(named_edges(s, True), SEARCH_NODES)),
    "deep_paths": ("c string, d string, nodes array<string>", lambda s: chain_paths(named_edges(s, False), DEEP_NODES)),
    "domain": ("p string, c string", lambda s: list(s.domain)),
    "range": ("p string, c string", lambda s: list(s.range)),
    "or": ("x string, c string", lambda s: [(k, o) for k, e in s.expressions.items() if e.kind == "or" for o in e.operands]),
    "and": ("x string, c string, n int", lambda s: [(k, o, len(set(e.operands))) for k, e in s.expressions.items() if e.kind == "and" for o in dict.fromkeys(e.operands)]),
    "some": ("x string, p string, f string", lambda s: _expressions(s, "some")),
    "all": ("x string, p string, f string", lambda s: _expressions(s, "all")),
    "self": ("x string, p string", lambda s: [r[:2] for r in _expressions(s, "self")]),
    "value": ("x string, p string, o string", lambda s: _expressions(s, "value")),
    "max_one": ("x string, p string, f string", lambda s: [(k, e.prop, e.filler or THING) for k, e in s.expressions.items() if e.kind in ("max", "exact") and e.n == 1]),
    "witnessed": ("c string, x string, p string, f string", _witnessed),
    "keys": ("id string, c string, p string, at int, n int", lambda s: [(str(k), c, p, i, len(ps)) for k, (c, ps) in enumerate(s.keys) for i, p in enumerate(ps)]),
    "disjoint": ("axiom string, c string, at int", _disjoint),
    "disjoint_property": (_PQ, lambda s: list(s.disjoint_property)),
    "different": ("axiom string, s string", lambda s: list(s.all_different)),
    "and_below": ("d string, x string, c string, n int, k int", lambda s: [r for r in _operands(s, "and", True) if r[3] >= 2]),
    "and_equal": ("d string, x string, c string, k int", lambda s: [(d, x, o, k) for d, x, o, _, k in _operands(s, "and", False) if k >= 2]),
    "or_equal": ("d string, x string, c string", lambda s: [r[:3] for r in _operands(s, "or", False)]),
    "some_of": (_DXPF, lambda s: _restrictions(s, "some")),
    "all_of": (_DXPF, lambda s: _restrictions(s, "all")),
    "mixed_named": ("d string, x string, k int, c string", lambda s: _mixed(s)[0]),
    "mixed_some": ("d string, x string, k int, p string, f string", lambda s: _mixed(s)[1]),
}
#: Kinds of properties that are lists of names.
CHARACTERISTICS = ("symmetric", "transitive", "functional", "inverse_functional", "reflexive", "irreflexive", "asymmetric")
