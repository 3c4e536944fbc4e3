"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long): root is the smallest node that it reaches.

    Each round every node takes the smallest label among its neighbours' and its own, then its label's label; rounds are
    about the logarithm of the longest path. Labels are written to the shared folder after each round; none go to the driver.
    Loops and repeated edges are harmless; rows with a null end are no edges; no edges give no rows.
    """
    spark = edges.sparkSession
    ends = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    n = 2 * ends.count()
    both = common.written(ends.select("a", "b").union(ends.select("b", "a")).distinct(), "edges", n)
    # the smallest neighbour is a first label that needs no join
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels", n)
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        nearer = labels.select("node", "root").join(around, "node").select("node", F.least("root", "low").alias("next"), F.col("root").alias("was"))
        nearer = common.written(nearer, "labels", n)
        # members of a large cluster all have one next node
        jump = common.spread_join(nearer, nearer.select(F.col("node").alias("next"), F.col("next").alias("far")), "next")
        fresh = common.written(jump.select("node", F.least("next", "far").alias("root"), "was"), "labels", n)
        common.discard(labels, nearer)
        labels = fresh
        if not fresh.where("root <> was").limit(1).count():
            common.discard(both)
            return fresh.select("node", "root")
