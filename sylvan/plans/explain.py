"""Why a selector did or didn't match: counters and near misses of a first-match query, by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.plans.select import as_selector, match_group, match_scoped
from sylvan.selector import predicates
from sylvan.selector.parser import Selector

#: Near misses and groups that a report has room for.
NEAR_MISSES, GROUPS = 8, 8


def _failure(group: tuple, number: int, first_compound: int, anchored: Column) -> Column:
    """The first failing test of a group's last compound, as a struct; null if no test tells."""
    last, at = group[-1], first_compound + len(group) - 1
    make = lambda kind, predicate: F.struct(F.lit(kind).alias("kind"), F.lit(number).cast("long").alias("group_index"), F.lit(at).cast("long").alias("compound_index"), F.lit(predicate).cast("long").alias("predicate_index"))
    tests = predicates.steps(last)
    out = None
    for i, (kind, test) in enumerate(tests):
        out = F.when(~test, make(kind, i)) if out is None else out.when(~test, make(kind, i))
    if len(group) > 1:
        rest = make("combinator", None)
    elif last.combinator is not None:
        rest = F.when(~anchored, make("scope", None))
    else:
        rest = F.lit(None)
    return rest if out is None else out.otherwise(rest)


def _evaluated(nodes: DataFrame, selector: Selector, scopes: DataFrame | None) -> DataFrame:
    """Elements in range with a flag for each group and the failure of the first group that has one."""
    keys = ["doc_id"] if scopes is None else ["doc_id", "scope_idx"]
    e = nodes.where("kind = 'element'")
    if scopes is not None:
        ends = scopes.select("doc_id", "scope_idx").distinct().join(nodes.select("doc_id", F.col("node_idx").alias("scope_idx"), F.col("subtree_end").alias("__end")), ["doc_id", "scope_idx"])
        e = e.join(ends, "doc_id").where((F.col("node_idx") > F.col("scope_idx")) & (F.col("node_idx") <= F.col("__end")))
    failures, compound = [], 0
    for g, group in enumerate(selector.groups):
        scope = F.lit(0) if scopes is None else F.col("scope_idx")
        first = group[0].combinator
        anchored = F.col("parent") == scope if first == "child" else F.lit(first is None)
        if scopes is None:
            hits = match_group(nodes, group)
        else:
            hits = match_scoped(nodes, scopes, Selector(selector.source, (group,)))
        e = e.join(hits.withColumn(f"__g{g}", F.lit(True)), [*keys, "node_idx"], "left")
        failures.append(F.when(F.col(f"__g{g}").isNull(), _failure(group, g, compound, anchored)))
        compound += len(group)
    hit = F.coalesce(*[F.when(F.col(f"__g{g}"), F.lit(g)) for g in range(len(selector.groups))])
    return e.select(*keys, "node_idx", hit.cast("long").alias("group"), F.coalesce(*failures).alias("failure"))


def report(nodes: DataFrame, selector: str | Selector, scopes: DataFrame | None = None) -> DataFrame:
    """A row for each document (or scope): visited_elements up to the first match, matched_index, matched_group, and by group
    how often it was tried (group_eval_counts) and matched (group_match_counts)."""
    s = as_selector(selector)
    keys = ["doc_id"] if scopes is None else ["doc_id", "scope_idx"]
    every = nodes.where("node_idx = 0").select("doc_id") if scopes is None else scopes.select(*keys).distinct()
    hit = F.col("group").isNotNull().cast("int")
    earlier = F.coalesce(F.max(hit).over(Window.partitionBy(*keys).orderBy("node_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = _evaluated(nodes, s, scopes).withColumn("__visited", 1 - earlier)
    first = e.groupBy(*keys).agg(F.min(F.when(F.col("group").isNotNull(), F.struct("node_idx", "group"))).alias("__m"), F.sum("__visited").alias("__n"))
    visited = F.coalesce(F.col("__n"), F.lit(0)).cast("long")
    out = every.join(first, keys, "left").select(*keys, visited.alias("visited_elements"), F.col("__m.node_idx").cast("long").alias("matched_index"), F.col("__m.group").alias("matched_group"))
    held = range(min(len(s.groups), GROUPS))
    tried = F.array(*[F.col("visited_elements") - F.coalesce((F.lit(g) > F.col("matched_group")).cast("long"), F.lit(0)) for g in held])
    matched = F.array(*[F.coalesce((F.lit(g) == F.col("matched_group")).cast("long"), F.lit(0)) for g in held])
    return out.withColumn("group_eval_counts", tried).withColumn("group_match_counts", matched)


def near_misses(nodes: DataFrame, selector: str | Selector, scopes: DataFrame | None = None) -> DataFrame:
    """(doc_id, rank, node_idx, kind, group_index, compound_index, predicate_index): the first visited elements that failed.
    Failures without a single test to blame (combinator, scope) have no predicate_index."""
    keys = ["doc_id"] if scopes is None else ["doc_id", "scope_idx"]
    e = _evaluated(nodes, as_selector(selector), scopes)
    w = Window.partitionBy(*keys).orderBy("node_idx")
    before = F.max(F.col("group").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0
    missed = e.withColumn("__open", before).where(F.col("__open") & F.col("failure").isNotNull())
    return missed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEAR_MISSES).select(*keys, F.col("rank").cast("long").alias("rank"), F.col("node_idx").cast("long").alias("node_idx"), "failure.*")
