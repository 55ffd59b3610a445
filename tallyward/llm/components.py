"""Connected components of an undirected graph given as an edge table.

Alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
each round rewires every node to the smallest neighbour it knows, first from above, then from below,
until every component is a star around its smallest node. The number of rounds is logarithmic in
practice. Smallest neighbours come from a map-side combined minimum and go back by a join, so a hub's
edges are never gathered in one group; the join may split a hub's rows (AQE skew join). Each round is
written to the shared folder, which also cuts the lineage.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import stage

EDGE = "src BIGINT, dst BIGINT"


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        .alias("e")
    ).select("e.src", "e.dst")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or the node itself)."""
    around = _both_ways(edges)
    least = around.groupBy("src").agg(F.min("dst").alias("least"))
    least = least.select("src", F.least("src", "least").alias("least"))
    return around.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    down = edges.where("dst < src")
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    moved = down.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component: the smallest node reachable. Only nodes with an edge to another are returned.

    edges has BIGINT columns src and dst; loops, repeated edges and edges with NULLs do no harm.
    """
    linked = edges.where("src <> dst")
    linked = linked.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    current = stage(linked, label)
    while True:
        after = stage(_small_star(_large_star(current)).distinct(), label)
        # Finished when each node hangs on one node that hangs on nothing.
        heads = after.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        open_ends = after.join(after.select(F.col("src").alias("dst")), "dst", "left_semi")
        if not heads.where("n > 1").head(1) and not open_ends.head(1):
            return after.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
                after.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            )
        current = after
