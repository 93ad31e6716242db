"""Connected components by alternating large-star and small-star (Kiveris and others, 2014), as DataFrame operations.

Each round first moves every larger neighbour of a node to the smallest node next to it (large-star), then does the
same with the smaller neighbours (small-star). The edges end as one star per component around its smallest node, after
about log2(longest path) rounds. A node's neighbours are never gathered: minima are aggregated, then joined, so a node
with a third of all edges is combined before the shuffle and its edges are spread over several tasks in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, released, written


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: then all is settled."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("larger")).union(edges.select("u", F.lit(0)))
    counts = ends.groupBy("node").agg(F.sum("larger").alias("n"), F.min("larger").alias("least"))
    return counts.where("n > 1 or (n = 1 and least = 0)").isEmpty()


def _star(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """v is tied to the hub of u, for (u, v) in pairs; hubs(u, hub, n_rows)."""
    joined = hot_join(pairs, hubs.select("u", "hub"), "u", hubs.select("u", "n_rows"), F.xxhash64("v"))
    return joined.select(F.col("v"), F.col("hub").alias("u")).where("u < v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v): any orderable type, either direction, repeats and loops allowed; nulls are no edges.

    Returns node, component: the smallest node that can be reached, for every node of an edge between two nodes; a table
    that the caller may release.
    """
    now = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    for _ in range(most_rounds):
        if _is_forest_of_stars(now):
            break
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        hubs = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("hub"), F.count("*").alias("n_rows"))
        large = written(_star(both.where("v > u"), hubs), "large-star")
        released(now)
        # small-star: from the larger end, which also is tied to the hub itself
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        hubs = down.groupBy("u").agg(F.min("v").alias("hub"), F.count("*").alias("n_rows"))
        small = _star(down, hubs).union(hubs.select(F.col("u").alias("v"), F.col("hub").alias("u")))
        now = written(small.select("u", "v").where("u < v").distinct(), "small-star")
        released(large)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = written(now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct()), "components")
    released(now)
    return out
