"""Problem 6: score cutoffs that keep a target fraction per source, exact by histogram refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.session import cut

#: Bins per source and round. Only the bin that holds the target rank comes to the driver, one row per source.
BINS = 512


def edges(rows: DataFrame, targets: DataFrame, score: str = "score") -> DataFrame:
    """source, keep_permille, n, cutoff for each target.

    rows: ``source`` (string) and a finite score; they are read once a round,
    so cut their lineage first. targets: a closed list of source and
    keep_permille (0 to 1000) that does not grow with the rows. The cutoff is
    the greatest score that keeps at least n * keep_permille / 1000 rows, but
    one row at least; ties at the cutoff are all kept. A source without rows
    has n = 0 and a null cutoff. Null scores, null sources and sources
    without a target are left out; of repeated targets the least holds.

    Each round counts scores into bins of the live interval of each source and
    zooms into the bin that holds the target rank, bounded by the least and
    greatest score seen in it; a source is done when both are equal.
    """
    spark: SparkSession = rows.sparkSession
    wanted = {r["source"]: int(r["k"]) for r in targets.where("source is not null and keep_permille is not null").groupBy("source").agg(F.min("keep_permille").alias("k")).collect()}
    data = _scored(rows, score)
    first = {r["source"]: r for r in data.groupBy("source").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).join(F.broadcast(_frame(spark, [(s,) for s in wanted], "source string")), "source").collect()}
    state = {s: {"lo": r["lo"], "hi": r["hi"], "above": 0, "n": r["n"], "rank": max(1, -(-r["n"] * wanted[s] // 1000))} for s, r in first.items()}
    while live := [(s, x["lo"], x["hi"], x["rank"] - x["above"]) for s, x in state.items() if x["lo"] < x["hi"]]:
        zoom = F.broadcast(_frame(spark, live, "source string, lo double, hi double, want bigint"))
        inside = data.join(zoom, "source").where((F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi")))
        part = F.coalesce(F.try_divide(F.col("score") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.when(F.col("score") > F.col("lo"), 1.0).otherwise(0.0))
        bins = inside.withColumn("bin", F.least(F.floor(part * BINS), F.lit(BINS - 1)).cast("int")).groupBy("source", "bin").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.first("want").alias("want"))
        upto = F.sum("n").over(W.partitionBy("source").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))
        for r in bins.withColumn("upto", upto).where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).collect():
            x = state[r["source"]]
            x["lo"], x["hi"], x["above"] = r["lo"], r["hi"], x["above"] + r["upto"] - r["n"]
    return _frame(spark, [(s, k, state[s]["n"] if s in state else 0, float(state[s]["lo"]) if s in state else None) for s, k in wanted.items()], "source string, keep_permille int, n bigint, cutoff double")


def _scored(rows: DataFrame, score: str) -> DataFrame:
    return rows.where(F.col("source").isNotNull() & F.col(score).isNotNull()).select("source", F.col(score).alias("score"))


def cutoffs(rows: DataFrame, targets: DataFrame, score: str = "score") -> DataFrame:
    """source, keep_permille, n, cutoff (of ``edges``) and kept, the rows at or above it; 0 for a source without rows."""
    found = edges(rows, targets, score)
    kept = _scored(rows, score).join(F.broadcast(found.select("source", "cutoff")), "source").where(F.col("score") >= F.col("cutoff")).groupBy("source").agg(F.count("*").alias("kept"))
    return found.join(kept, "source", "left").fillna(0, ["kept"])


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def kept_rows(rows: DataFrame, found: DataFrame, score: str = "score") -> DataFrame:
    """The rows at or above their source's cutoff (one row per target)."""
    return rows.join(F.broadcast(found.select("source", "cutoff")), "source").where(F.col(score) >= F.col("cutoff")).drop("cutoff")


def settle(rows: DataFrame) -> DataFrame:
    """Rows that the rounds read again and again, as a checkpoint."""
    return cut(rows)
