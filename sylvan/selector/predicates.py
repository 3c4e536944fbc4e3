"""Compounds as Column expressions over a node row. Every predicate is null-safe: it is true or false."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan.selector.parser import Attribute, Compound, Pseudo

_SPLIT = r"[ \n\r\t\f]+"


def _safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def attr(name: str) -> Column:
    """id comes from its own column, which files can be pruned by."""
    return F.col("id") if name == "id" else F.try_element_at(F.col("attr_map"), F.lit(name))


def attribute(a: Attribute) -> Column:
    v, x = attr(a.name), F.lit(a.value)
    return {
        "exists": lambda: v.isNotNull(),
        "eq": lambda: v.eqNullSafe(x),
        "prefix": lambda: _safe(F.startswith(v, x)),
        "suffix": lambda: _safe(F.endswith(v, x)),
        "contains": lambda: _safe(F.contains(v, x)),
        "includes": lambda: _safe(F.array_contains(F.split(v, _SPLIT), a.value)) if a.value else F.lit(False),
        "dash": lambda: _safe((v == x) | F.startswith(v, F.lit(a.value + "-"))),
    }[a.op]()


def has_class(name: str, times: int = 1) -> Column:
    """A class named twice asks for two such tokens."""
    if times == 1:
        return _safe(F.array_contains("classes", name))
    return _safe(F.size(F.filter("classes", lambda c: c == name)) >= times)


def pseudo(p: Pseudo) -> Column:
    if p.kind == "first-child":
        return F.col("prev_sibling").isNull()
    if p.kind == "last-child":
        return _safe(F.col("is_last"))
    at = F.col("sib_pos") - p.b
    # a top-level element has no parent element to be counted in
    hit = at == 0 if p.a == 0 else (at % abs(p.a) == 0) & (at >= 0 if p.a > 0 else at <= 0)
    return _safe((F.col("parent") != 0) & hit)


def negated(item: tuple) -> Column:
    kind, what = item
    if kind == "tag":
        return F.col("tag") != what
    if kind == "id":
        return ~F.col("id").eqNullSafe(what)
    return ~(has_class(what) if kind == "class" else attribute(what))


def compound(c: Compound) -> Column:
    """Cheap tests first; the node is an element."""
    tests = [F.col("kind") == "element"]
    if c.tag is not None:
        tests.append(F.col("tag") == c.tag)
    if c.id is not None:
        tests.append(F.col("id").eqNullSafe(c.id))
    tests += [has_class(name, n) for name, n in Counter(c.classes).items()]
    tests += map(attribute, c.attrs)
    tests += map(pseudo, c.pseudos)
    tests += map(negated, c.nots)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def steps(c: Compound) -> list[tuple[str, Column]]:
    """The tests of a compound one by one with the kind of failure each means, as diagnostics count them."""
    out: list[tuple[str, Column]] = []
    if c.tag is not None:
        out.append(("tag", F.col("tag") == c.tag))
    if c.id is not None:
        out.append(("id", F.col("id").eqNullSafe(c.id)))
    out += [("class", has_class(x)) for x in c.classes]
    out += [("attr", attribute(x)) for x in c.attrs]
    out += [("pseudo", pseudo(x)) for x in c.pseudos]
    out += [("not_simple", negated(x)) for x in c.nots]
    return out
