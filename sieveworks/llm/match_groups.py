"""Problem 4: one group identifier for all records that pairs link directly or through others.

Union-find runs inside edge partitions and leaves only a spanning forest of
stars (member, least member; a root is its own member). A vertex that got
roots in several partitions links those roots: these links are the edges of the
next, smaller graph, which is treated alike in fewer partitions, until one is
left. The labels of the levels are then joined back, from the last level to the
first.

Edges are dealt to the partitions by neighbourhood: a vertex is named after the
neighbour (or itself) with the least random key, and edges whose first ends
have one name meet. A forest then holds whole neighbourhoods, so that a level
halves the vertices whatever the shape of the graph (a chain of n keeps about
n / 2 roots) and the levels grow as the logarithm of the edges. Names that gather
more edges than a task holds are dealt on by the other end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.session import cut, saved

#: Edges that one task holds at most, up to the spread of a hash partitioning.
EDGES_PER_TASK = 1 << 15


def forest(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """Every vertex of an edge list and its root, the least vertex of its local component."""
    names = pc.unique(pa.chunked_array([*a.chunks, *b.chunks], a.type))
    names = names.take(pc.sort_indices(names))
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(pc.index_in(a, names).to_pylist(), pc.index_in(b, names).to_pylist(), strict=True):
        rx, ry = find(x), find(y)
        if rx < ry:
            parent[ry] = rx
        elif ry < rx:
            parent[rx] = ry
    return names, names.take(pa.array([find(x) for x in range(len(names))], pa.int64()))


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [x for x in batches if x.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        member, root = forest(t["a"], t["b"])
        yield from pa.table({"member": member, "root": root}).to_batches(max_chunksize=100_000)


def dealt(edges: DataFrame, n: int, edges_per_task: int, level: int) -> DataFrame:
    """The n edges in partitions of about ``edges_per_task``, those of one neighbourhood together."""
    key = lambda c: F.xxhash64(F.lit(level), F.col(c))
    ends = edges.select("a", key("b").alias("k")).unionByName(edges.select(F.col("b").alias("a"), key("a").alias("k")))
    names = ends.groupBy("a").agg(F.min("k").alias("k")).select("a", F.least("k", key("a")).alias("name"))
    named = cut(edges.join(names, "a").select("a", "b", "name"))
    crowded = named.groupBy("name").agg(F.ceil(F.count("*") / edges_per_task).alias("tasks")).where("tasks > 1")
    rows = named.join(saved(crowded, "crowded"), "name", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("tasks", F.lit(1))))
    return rows.repartition(-(-n // edges_per_task), "name", "part").select("a", "b")


def linked_groups(pairs: DataFrame, edges_per_task: int = EDGES_PER_TASK, progress: list[int] | None = None) -> DataFrame:
    """group_id, record: one row for each record with a link; group_id is the least record of its group.

    pairs: columns a and b of one ordered type. Pairs with a null end and pairs
    of a record with itself link nothing; repeated and turned-round pairs count
    once. An empty table gives no row. ``progress`` takes the number of edges of
    every level.
    """
    kind = dict(pairs.dtypes)["a"]
    link = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, levels, progress = cut(link.distinct()), [], [] if progress is None else progress
    while n := edges.count():
        progress.append(n)
        alone = n <= edges_per_task
        spread = edges.coalesce(1) if alone else dealt(edges, n, edges_per_task, len(levels))
        stars = cut(spread.mapInArrow(_local_forest, f"member {kind}, root {kind}"))
        if alone:
            levels.append(stars)
            break
        best = cut(stars.groupBy("member").agg(F.min("root").alias("root"), F.max("root").alias("last")))
        levels.append(best.select("member", "root"))
        parted = best.where("root <> last").select("member", F.col("root").alias("a"))
        edges = cut(stars.join(parted, "member").where("a <> root").select("a", F.col("root").alias("b")).distinct())
    if not levels:
        return link.select(F.col("a").alias("group_id"), F.col("a").alias("record")).limit(0)
    labels = levels.pop()
    while levels:
        up = labels.select(F.col("member").alias("root"), F.col("root").alias("far"))
        labels = levels.pop().join(up, "root", "left").select("member", F.coalesce("far", "root").alias("root"))
    return labels.select(F.col("root").alias("group_id"), F.col("member").alias("record"))
