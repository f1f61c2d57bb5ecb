"""Connected components of an edge table by alternating large and small stars.

Each round replaces edges by edges to a smaller label: in the large star every
larger neighbour of a node is linked to the node's minimum, in the small star the
node and its smaller neighbours are. Both are a partial ``min`` per node and a
join of that minimum back to the edges; nothing is gathered per node. Every
round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.llm.common import store


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v in, the same out."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges in any direction -> (node, root), one row per node with an edge; root is the smallest node."""
    flat = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "cc-edges")
    before = _signature(flat)
    while True:
        flat = store(_star(_star(flat, True), False), "cc-round")
        now = _signature(flat)
        if now == before:
            break
        before = now
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
