"""Connected components of an edge list by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.session import cut


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Every vertex ``id`` with the least id of its component as ``component``.

    edges: columns a, b; edges with a null end, loops and repeats change
    nothing, and ends that are no vertices are left out. A vertex without an
    edge is its own component. Each round takes the least label of the
    neighbours (partial aggregation in the map side keeps hubs cheap), then
    jumps to the label's label, so the rounds grow as the logarithm of a chain.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return vertices.select("id").distinct().withColumn("component", F.col("id"))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        nxt = labels.join(seen.select(F.col("a").alias("id"), "c"), "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("mid"))
        hop = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        nxt = cut(nxt.join(hop, "mid").select("id", "old", F.least("mid", "far").alias("component")))
        changed = nxt.where(F.col("old") != F.col("component")).limit(1).count()
        labels = nxt.select("id", "component")
        if not changed:
            break
    return vertices.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
