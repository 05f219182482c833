"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import discard, materialise


#: A node with more edges than this, and than a MOST_HUBS-th part of all edges, is a hub.
HUB, MOST_HUBS = 64, 10_000


def _star(edges: DataFrame, large: bool, limit: int) -> DataFrame:
    """One star step. Each node's smallest neighbour is a map-side-combined minimum that meets the node's edges
    in a join. Hubs, nodes of more than limit edges, are broadcast, so that no task gets all edges of one; there
    are 2 * MOST_HUBS of them at most, as limit grows with the edges."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    hubs = F.broadcast(low.where(F.col("_n") > limit).select("u", F.col("m").alias("_hub")))
    marked = both.join(hubs, "u", "left")
    rest = marked.where(F.col("_hub").isNull()).select("u", "v").join(low.where(F.col("_n") <= limit).select("u", "m"), "u")
    joined = rest.union(marked.where(F.col("_hub").isNotNull()).select("u", "v", F.col("_hub").alias("m")))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "edges", max_rounds: int = 50) -> DataFrame:
    """(node, label): label is the smallest node that node reaches. edges: (u, v), whole numbers, u <> v.

    Only nodes with an edge are returned. The rounds grow as the logarithm of the longest path; each is
    written to the shared folder in place of the one before, and the driver sees a row count and a checksum only.
    """
    current = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    seen, limit = None, max(HUB, 2 * current.count() // MOST_HUBS)
    for _ in range(max_rounds):
        before, current = current, materialise(_star(_star(current, True, limit), False, limit), name)
        discard(before)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(current.select("v", "v").distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
