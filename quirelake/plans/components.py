"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Each node of ``edges`` with ``component``, the smallest node that it is connected to.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each node's neighbours are
    linked to their common minimum, so paths halve and no node's neighbours are ever gathered in
    a list; the minimum per node is a pre-aggregated ``min``. Each round is cut by a checkpoint
    and a checksum of the edges tells when nothing changes. Null ends and self-loops: dropped,
    but a node with only a self-loop comes out as its own component. An empty table gives none.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = both.select("u").union(both.select("v")).distinct()
    e = cut(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        # large-star: every neighbour greater than the node is linked to the smallest of node and neighbours
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: each node and its smaller neighbours are linked to the smallest of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
