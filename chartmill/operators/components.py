"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge: root is the least node that is reachable from it.

    Edges are undirected; loops, repeated edges and edges with a null end are dropped.  A round is two grouped
    minima and two joins, whatever the size of a component: no component is gathered anywhere.  The number of
    rounds grows with the logarithm of the longest path.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = cut(now)
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u > v").distinct()
        small = _with_least(large)
        now = cut(small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v"))).where("u > v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
