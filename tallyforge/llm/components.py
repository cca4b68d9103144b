"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, forget


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every node of `edges(a, b)` with the smallest node it reaches: `(node, root)`.

    Large-star and small-star rounds alternate until the edge set stands still. A round moves each edge to the
    smallest known neighbour, so a long chain halves and a hub keeps one edge per member. Only two counters per
    round reach the driver. Empty input gives an empty table; self loops and repeated edges change nothing.
    """
    links = durable(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    state = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = links.agg(*state).first()
    for _ in range(rounds if before[0] else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, last = durable(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()), links
        forget(last)
        now = links.agg(*state).first()
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("the components did not settle")
    roots = links.select("v").distinct()
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        roots.join(links.select(F.col("u").alias("v")), "v", "left_anti").select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
