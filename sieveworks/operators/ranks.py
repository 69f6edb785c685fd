"""Ranks and order statistics that never bring a group or a column into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.session import cut


def hash_rank(df: DataFrame, groups: list[str], order: str, tie: str, name: str = "rank", digits: int = 3) -> DataFrame:
    """df with the 1-based rank by a hex digest (ties by another column) and the size of each group, ``name`` and ``name_n``.

    The leading hex digits deal a group to 16**digits buckets; buckets are
    counted, and a row's rank is its rank in the bucket plus the rows of the
    buckets before it. Null group values form groups of their own.
    """
    rows = df.withColumn("_bucket", F.substring(order, 1, digits))
    counts = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*groups)
    state = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(w.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias(f"{name}_n"))
    on = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy(order, tie))
    out = rows.withColumn("_local", local).join(state, on)
    return out.withColumn(name, F.col("_local") + F.col("_before")).drop("_bucket", "_b", "_before", "_local", *[f"_g{i}" for i in range(len(groups))])


def percentiles(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """One row with n, and q0, q1, ... : the percentiles with linear interpolation, exact, nulls left out; null if there is no value.

    Distinct values are counted and range-partitioned in order; running sums in
    each partition and the sums of the partitions before it (one number per
    partition) give the ranks, and only the two values around each rank leave
    their partitions.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    parted = cut(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sums = {r["p"]: r["c"] for r in parted.groupBy("p").agg(F.sum("c").alias("c")).collect()}
    total, before, offsets = sum(sums.values()), 0, []
    for p in sorted(sums):
        offsets.append((p, before))
        before += sums[p]
    names = [f"q{i}" for i in range(len(qs))]
    if not total:
        return spark.createDataFrame([(0, *[None] * len(qs))], "n bigint, " + ", ".join(f"{x} double" for x in names))
    run = F.sum("c").over(W.partitionBy("p").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = parted.withColumn("hi", run).join(F.broadcast(spark.createDataFrame(offsets, "p int, before bigint")), "p").select("v", (F.col("before") + F.col("hi")).alias("hi"), (F.col("before") + F.col("hi") - F.col("c")).alias("lo"))
    at = lambda i: F.max(F.when((F.col("lo") <= i) & (F.col("hi") > i), F.col("v")))
    cols: list[Column] = []
    for q, x in zip(qs, names, strict=True):
        pos = q * (total - 1)
        low = int(pos)
        cols.append((at(low) + (at(min(low + 1, total - 1)) - at(low)) * (pos - low)).alias(x))
    return ranked.agg(F.lit(total).alias("n"), *cols)
