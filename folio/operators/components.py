"""Connected components of an undirected graph as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import cut_lineage, never_broadcast


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges -> (node, component): the least node of each component.

    Alternates large-star and small-star steps; each is one shuffle on the node with
    only minima taken per node, and a hot node's edges are aggregated before the
    shuffle. Lineage is cut by a reliable checkpoint each round. Nodes without edges
    don't occur; loops and repeats are harmless; edges with a null end are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = cut_lineage(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    seen = None
    while True:  # to the fixed point; a round at least halves the distances to the least nodes
        # Large star: every node's greater neighbours point to its least neighbour (or itself).
        least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = e.join(never_broadcast(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every node and its lesser neighbours point to the least of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(never_broadcast(small_least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").filter("u <> v").distinct()
        down = cut_lineage(small)
        state = down.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
        e = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return down.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
