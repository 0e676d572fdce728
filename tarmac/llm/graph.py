"""Connected components by alternating large and small stars.

Each round hangs a node's neighbours on the least node it knows, first the larger ones, then the smaller; the graph ends as one star for each component. All steps are joins and minimum aggregates over edges, so a node of very many edges is combined before the shuffle, and split by adaptive execution where it is joined. Each round is written to the shared folder, and the one before deleted; nothing comes to the driver but whether all components are stars yet, which ends it. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import apart, removed, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b: long) but the roots themselves. Loops and repeated edges are ignored; no edges, no rows."""

    def star(e: DataFrame) -> DataFrame:
        """Each node's least neighbour, or itself if that is less; for a join that can split a node of very many edges."""
        return e.groupBy("u").agg(F.min("v").alias("least")).select(apart(F.col("u")).alias("of"), F.least("u", "least").alias("least"))

    def all_stars(e: DataFrame) -> bool:
        """No node has two edges down, or one down and one up."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select(F.col("v"), F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 AND down > 0").isEmpty()

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "graph", narrow=True)
    while not all_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(star(both), F.col("u") == F.col("of")).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = star(large)
        hung = large.join(least, F.col("u") == F.col("of"))
        small = hung.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select(F.col("of").alias("u"), F.col("least").alias("v"))).distinct()
        after = written(small, "graph", narrow=True)
        removed(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hung_low(edges: DataFrame) -> DataFrame:
    """Edges (a, b: long) of the same components, fewer where many nodes share their ``b``: an ``a`` and all its ``b`` are hung on the least of them. A row holds all ``b`` of an ``a``, so these should be few; how many ``a`` a ``b`` has doesn't matter."""
    ends = edges.groupBy("a").agg(F.collect_set("b").alias("ends")).select(F.array_union(F.array("a"), "ends").alias("ends"))
    return ends.select(F.explode("ends").alias("a"), F.array_min("ends").alias("b")).filter("a <> b")


def least_of_class(first: DataFrame, node: str, hung: DataFrame) -> DataFrame:
    """of, component_id: for each ``node`` (long) of ``first`` the least value of its column ``first`` in the node's class; ``hung`` as from ``components``."""
    known = first.join(hung, F.col(node) == F.col("node"), "left").select(F.col(node).alias("of"), "first", F.coalesce("root", node).alias("root"))
    # a class may have very many members
    least = known.groupBy("root").agg(F.min("first").alias("component_id")).select(apart(F.col("root")).alias("of_root"), "component_id")
    return known.join(least, F.col("root") == F.col("of_root")).select("of", "component_id")
