"""Exact selection of the smallest keys of each group without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Leading hex digits of the key that name a bucket: the counts that are held per group are 16**DIGITS at most.
DIGITS = 3
BUCKETS = 16**DIGITS


def random_key(seed: int, id_col: str) -> Column:
    """The digest by which rows are drawn: sha256 of seed and id as hex; a null id is an empty one."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)


def smallest_keys(df: DataFrame, group: str, id_col: str, quota: str, seed: int = 0) -> DataFrame:
    """The ``quota`` rows of each group that have the smallest random keys; ties go to the smaller id.

    Rows are counted per group and bucket of keys, and the bucket in which the
    quota falls is found from the counts. Rows of earlier buckets are taken
    outright, only rows of that one bucket (1/4096 of the group) are ranked. The
    join is with one row per group, which is broadcast: use it for a closed list
    of groups. A null or non-positive quota takes no row.
    """
    rows = df.where(F.col(quota) > 0).withColumn("_key", random_key(seed, id_col)).withColumn("_bucket", F.conv(F.substring("_key", 1, DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"), F.first(quota).alias("_q"))
    upto = F.sum("_n").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    edges = counts.withColumn("_upto", upto).groupBy(F.col(group).alias("_g")).agg(
        F.coalesce(F.min(F.when(F.col("_upto") >= F.col("_q"), F.col("_bucket"))), F.lit(BUCKETS)).alias("_edge"),
        F.coalesce(F.max(F.when(F.col("_upto") < F.col("_q"), F.col("_upto"))), F.lit(0)).alias("_whole"),
    )
    near = rows.join(F.broadcast(edges), (F.col(group) == F.col("_g")) & (F.col("_bucket") <= F.col("_edge")))
    rank = F.row_number().over(W.partitionBy(group, "_bucket").orderBy("_key", id_col))
    taken = near.withColumn("_r", rank).where((F.col("_bucket") < F.col("_edge")) | (F.col("_r") + F.col("_whole") <= F.col(quota)))
    return taken.drop("_key", "_bucket", "_g", "_edge", "_whole", "_r")
