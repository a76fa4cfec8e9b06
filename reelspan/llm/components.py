"""Connected components of links by alternating stars, in tables of links only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm import common


def _min_neighbour(links: DataFrame) -> DataFrame:
    """u, v, m: every link with the smallest of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    return links.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def components(links: DataFrame, most: int = 40) -> DataFrame:
    """node, component (the smallest node reachable) for each node of ``links(a, b)``. Each round links larger
    neighbours to the smallest (large star), then smaller ones (small star); rounds grow with the logarithm of the
    longest path. Neither step gathers a node's neighbours: a node's minimum is a map-side aggregate, joined back."""
    held = common.staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _min_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every link runs from the larger to the smaller node here.
        low = _min_neighbour(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = common.staged(small, "links")
        same = after.join(held, ["u", "v"], "left_anti").isEmpty() and held.join(after, ["u", "v"], "left_anti").isEmpty()
        common.discard(held)
        held = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    # Settled links are stars: each node points to its component's smallest.
    return held.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
