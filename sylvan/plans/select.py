"""Selectors as DataFrame plans over a node table.

A chain of compounds is taken from left to right, a whole set at a time: of the nodes that match the next compound, those
stay that stand in its combinator's relation to a node found before. Every step is keyed by document, so a node table that is
hash-partitioned by doc_id needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.selector import predicates
from sylvan.selector.parser import Compound, Selector, compiled

KEYS = ("doc_id", "node_idx")
_LINKS = ("doc_id", "node_idx", "parent", "prev_sibling", "subtree_end")


def as_selector(selector: str | Selector) -> Selector:
    return selector if isinstance(selector, Selector) else compiled(selector)


def _found(nodes: DataFrame, test: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    return nodes.where(test).select(*_LINKS, *extra)


def _step(nodes: DataFrame, before: DataFrame, c: Compound) -> DataFrame:
    """Nodes that match `c` and stand in its relation to a row of `before`."""
    test = predicates.compound(c)
    if c.combinator == "descendant":
        # intervals of subtrees never cross, so an ancestor was found iff the furthest end so far reaches this node
        marked = nodes.select(*_LINKS, test.alias("__hit")).join(before.select(*KEYS, F.col("subtree_end").alias("__end")), list(KEYS), "left")
        reach = F.max("__end").over(Window.partitionBy("doc_id").orderBy("node_idx").rowsBetween(Window.unboundedPreceding, -1))
        return marked.withColumn("__reach", reach).where(F.col("__hit") & (F.col("__reach") >= F.col("node_idx"))).select(*_LINKS)
    now = _found(nodes, test)
    if c.combinator == "sibling":
        first = before.groupBy("doc_id", "parent").agg(F.min("node_idx").alias("__first"))
        return now.join(first, ["doc_id", "parent"]).where(F.col("node_idx") > F.col("__first")).select(*_LINKS)
    link = "parent" if c.combinator == "child" else "prev_sibling"
    return now.join(before.select("doc_id", F.col("node_idx").alias(link)), ["doc_id", link], "left_semi").select(*_LINKS)


def _anchor(c: Compound) -> Column:
    """A leading combinator without scope relates to the document: only its children exist."""
    return F.lit(True) if c.combinator is None else F.col("parent") == 0 if c.combinator == "child" else F.lit(False)


def match_group(nodes: DataFrame, group: tuple[Compound, ...]) -> DataFrame:
    """(doc_id, node_idx) of one group's matches; each node once."""
    rows = _found(nodes, predicates.compound(group[0]) & _anchor(group[0]))
    for c in group[1:]:
        rows = _step(nodes, rows, c)
    return rows.select(*KEYS)


def match(nodes: DataFrame, selector: str | Selector) -> DataFrame:
    """(doc_id, node_idx) of all matches, each once: groups of one compound are one filter, others are joined by a union."""
    groups = as_selector(selector).groups
    simple = [g for g in groups if len(g) == 1]
    parts = [match_group(nodes, g) for g in groups if len(g) > 1]
    if simple:
        test = predicates.compound(simple[0][0]) & _anchor(simple[0][0])
        for g in simple[1:]:
            test = test | (predicates.compound(g[0]) & _anchor(g[0]))
        parts.insert(0, nodes.where(test).select(*KEYS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if len(parts) > 1 else out


def _anchored(nodes: DataFrame, scopes: DataFrame, group: tuple[Compound, ...]) -> DataFrame:
    """(doc_id, scope_idx, node_idx): a chain that starts at the children of each scope; every step carries the scope."""
    cols = [*_LINKS, "scope_idx"]
    if group[0].combinator != "child":  # siblings of a scope, and what hangs on them, lie outside it
        return nodes.where(F.lit(False)).select("doc_id", F.col("node_idx").alias("scope_idx"), "node_idx")
    rows = _found(nodes, predicates.compound(group[0])).join(scopes.select("doc_id", F.col("scope_idx").alias("parent"), "scope_idx"), ["doc_id", "parent"]).select(*cols)
    for c in group[1:]:
        now = _found(nodes, predicates.compound(c))
        if c.combinator == "descendant":
            p = rows.select("doc_id", F.col("node_idx").alias("__p"), F.col("subtree_end").alias("__end"), "scope_idx")
            rows = now.join(p, "doc_id").where((F.col("node_idx") > F.col("__p")) & (F.col("node_idx") <= F.col("__end"))).select(*cols).distinct()
        elif c.combinator == "sibling":
            first = rows.groupBy("doc_id", "scope_idx", "parent").agg(F.min("node_idx").alias("__first"))
            rows = now.join(first, ["doc_id", "parent"]).where(F.col("node_idx") > F.col("__first")).select(*cols)
        else:
            link = "parent" if c.combinator == "child" else "prev_sibling"
            rows = now.join(rows.select("doc_id", F.col("node_idx").alias(link), "scope_idx"), ["doc_id", link]).select(*cols)
    return rows.select("doc_id", "scope_idx", "node_idx")


def match_scoped(nodes: DataFrame, scopes: DataFrame, selector: str | Selector) -> DataFrame:
    """(doc_id, scope_idx, node_idx): matches inside each scope, itself excluded. `scopes` has (doc_id, scope_idx).

    Only the last compound must lie in the scope; the others may match its ancestors, unless the group begins with a
    combinator, which relates to the scope.
    """
    groups = as_selector(selector).groups
    ends = scopes.select("doc_id", "scope_idx").distinct().join(nodes.select("doc_id", F.col("node_idx").alias("scope_idx"), F.col("subtree_end").alias("__end")), ["doc_id", "scope_idx"])
    free = tuple(g for g in groups if g[0].combinator is None)
    parts = [_anchored(nodes, ends, g) for g in groups if g[0].combinator is not None]
    if free:
        hits = match(nodes, Selector(as_selector(selector).source, free))
        parts.append(hits.join(ends, "doc_id").where((F.col("node_idx") > F.col("scope_idx")) & (F.col("node_idx") <= F.col("__end"))).select("doc_id", "scope_idx", "node_idx"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if len(parts) > 1 else out
