"""Pools of groups, strata, the deterministic stratified split, and its invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.scalars import hash_order, stem, tertile
from sieveworks.operators.ranks import hash_rank, percentiles
from sieveworks.session import saved

# Pools, their roles and classes.
POOLS = {
    "polyp": ("primary_positive", ["polyps"]),
    "colonic_negative": ("primary_negative", ["cecum", "retroflex-rectum"]),
    "colonic_pathology_nonpolyp": ("c1_false_premise", ["ulcerative-colitis-grade-0-1", "ulcerative-colitis-grade-1", "ulcerative-colitis-grade-1-2", "ulcerative-colitis-grade-2", "ulcerative-colitis-grade-2-3", "ulcerative-colitis-grade-3", "hemorrhoids"]),
    "natural_degradation": ("natural_degradation", ["bbps-0-1", "impacted-stool"]),
    "upper_gi": ("c2_false_context", ["pylorus", "z-line", "retroflex-stomach", "esophagitis-a", "esophagitis-b-d", "barretts", "barretts-short-segment"]),
    "prep_adequate": ("excluded", ["bbps-2-3"]),
    "dyed": ("excluded", ["dyed-lifted-polyps", "dyed-resection-margins"]),
    "too_few": ("excluded", ["ileum"]),
}
# Splits in order with their shares.
PROPORTIONS = [("train", 0.25), ("est_train", 0.30), ("cal", 0.20), ("test", 0.25)]
SEED = 4127


def class_table(spark: SparkSession, pools: dict | None = None) -> DataFrame:
    """V8: class_label, pool, role; a closed configuration."""
    rows = [(c, p, role) for p, (role, classes) in (pools or POOLS).items() for c in classes]
    return spark.createDataFrame(rows, "class_label string, pool string, role string")


def row_pools(rows: DataFrame, pools: dict | None = None) -> DataFrame:
    """Pool and excluded of every row; classes without a pool give ``unassigned``, which is kept."""
    table = F.broadcast(class_table(rows.sparkSession, pools).withColumn("excluded", F.col("role") == "excluded").drop("role"))
    forced = F.coalesce(F.col("dataset") == "kvasir-seg-images", F.lit(False))
    r = rows.join(table, "class_label", "left").withColumn("pool", F.when(forced, "polyp").otherwise(F.coalesce("pool", F.lit("unassigned"))))
    return r.withColumn("excluded", F.coalesce("excluded", F.lit(False)) & ~forced)


def group_pools(rows: DataFrame, first: str = "polyp") -> DataFrame:
    """group, pool, excluded, pools (distinct) and dropped rows.

    rows: group, pool, excluded. The priority pool wins if any kept row has
    it, else the commonest kept pool (ties by name); a group without kept rows
    takes the commonest of all and is excluded.
    """
    counts = rows.groupBy("group", "pool", "excluded").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("excluded"), (F.col("pool") != first).alias("other"), (-F.col("n")).alias("m"), F.col("pool"))).alias("b")
    g = counts.groupBy("group").agg(best, F.count("*").alias("pools"), F.sum("n").alias("rows"), F.sum(F.when(F.col("excluded"), F.col("n")).otherwise(0)).alias("excluded_rows"))
    return g.select("group", F.col("b.pool").alias("pool"), F.col("b.excluded").alias("excluded"), "pools", F.when(F.col("b.excluded"), 0).otherwise(F.col("excluded_rows")).alias("dropped"))


def usable(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose group and whose own class are both kept, with the group's pool."""
    kept = groups.where("not excluded").select("group", F.col("pool").alias("group_pool"))
    return rows.where("not excluded").join(kept, "group").drop("pool", "excluded").withColumnRenamed("group_pool", "pool")


def laundered(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows of an excluded class that lie in a kept group, by class."""
    return rows.where("excluded").join(groups.where("not excluded").select("group"), "group").groupBy("class_label").agg(F.count("*").alias("rows"))


def mask_areas(inventory: DataFrame) -> DataFrame:
    """Stem, area; of several masks of a stem the one with the last path holds; error sentinels are left out."""
    masks = inventory.where(F.col("dataset").endswith("-masks") & (F.col("mask_area_frac") >= 0) & ~F.isnan("mask_area_frac"))
    return masks.groupBy(stem(F.col("rel_path")).alias("stem")).agg(F.max_by("mask_area_frac", F.struct("rel_path", "mask_area_frac")).alias("area"))


def _mode(rows: DataFrame, c: str) -> DataFrame:
    """group, pool and the commonest value of a column, of ties that of the least path.

    Most groups have one value, which is found without counts and paths; only
    the rows of the others are counted.
    """
    range_ = rows.groupBy("group", "pool").agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    mixed = saved(range_.where("_lo <> _hi").select("group", "pool"), "mixed")
    counts = rows.join(mixed, ["group", "pool"], "left_semi").groupBy("group", "pool", c).agg(F.count("*").alias("n"), F.min("rel_path").alias("f"))
    voted = counts.groupBy("group", "pool").agg(F.min_by(c, F.struct((-F.col("n")).alias("m"), "f")).alias(c))
    return range_.where("_lo = _hi").select("group", "pool", F.col("_lo").alias(c)).unionByName(voted)


def strata(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Group, pool, stratum = pool|commonest class|tertile.

    The tertile is the commonest among members that have a mask, ``nomask`` if
    none has one, ``-`` outside the polyp pool. Ties: the value of the least
    path. Cut points are the exact third and two thirds of all areas.
    """
    cuts = percentiles(areas, "area", [1 / 3, 2 / 3]).select(F.col("q0").alias("t1"), F.col("q1").alias("t2"))
    binned = areas.join(F.broadcast(cuts)).select("stem", tertile(F.col("area"), F.col("t1"), F.col("t2")).alias("bin"))
    r = rows.select("group", "pool", "rel_path", F.coalesce("class_label", F.lit("(none)")).alias("class"))
    bins = r.where("pool = 'polyp'").withColumn("stem", stem(F.col("rel_path"))).join(binned, "stem")
    s = _mode(r, "class").join(_mode(bins, "bin"), ["group", "pool"], "left")
    size = F.when(F.col("pool") == "polyp", F.coalesce("bin", F.lit("nomask"))).otherwise("-")
    return s.select("group", "pool", F.concat_ws("|", "pool", "class", size).alias("stratum"))


def stratified_split(keys: DataFrame, key: str, stratum: str, proportions: list[tuple[str, float]] | None = None, seed: int = SEED) -> DataFrame:
    """Keys with ``split``: members of a stratum in hash order, cut at half-even rounded cumulative shares."""
    shares = proportions or PROPORTIONS
    ranked = hash_rank(keys.withColumn("_h", hash_order(seed, F.col(stratum), F.col(key))), [stratum], "_h", key, "_r")
    out: Column = F.lit(shares[-1][0])
    edges, total = [], 0.0
    for s, p in shares[:-1]:
        total = round(total + p, 12)
        edges.append((s, total))
    for s, e in reversed(edges):
        out = F.when(F.col("_r") <= F.bround(F.lit(e) * F.col("_r_n")), s).otherwise(out)
    return ranked.withColumn("split", F.when(F.col("_r_n") == 1, "est_train").otherwise(out)).drop("_h", "_r", "_r_n")


def split_counts(rows: DataFrame) -> DataFrame:
    """Distinct groups per pool and split, pivoted, with totals."""
    g = rows.select("pool", "split", "group").distinct()
    return g.groupBy("pool").agg(*[F.count_if(F.col("split") == s).alias(s) for s, _ in PROPORTIONS], F.count("*").alias("total"))


def split_violations(rows: DataFrame) -> DataFrame:
    """Groups with several splits, groups with several pools, rows without a split."""
    per = rows.groupBy("group").agg(F.countDistinct("split").alias("s"), F.countDistinct("pool").alias("p"))
    a = per.agg(F.count_if(F.col("s") > 1).alias("groups_split"), F.count_if(F.col("p") > 1).alias("groups_pooled"))
    return a.join(F.broadcast(rows.agg(F.count_if(F.col("split").isNull()).alias("rows_without_split"))))


def require(checks: DataFrame) -> None:
    """Raise unless every count of a one-row frame of violation counts is 0."""
    bad = {k: v for k, v in checks.first().asDict().items() if v}
    if bad:
        raise ValueError(f"nothing is written: {bad}")


def canonical_rows(rows: DataFrame) -> DataFrame:
    """G1: one row per group: the copy of the segmentation set if the pool is polyp, else the first path.

    The least (not preferred, path) of a group is an aggregate, so that a hot
    group is combined before it is shuffled.
    """
    prefer = (F.col("pool") == "polyp") & F.coalesce(F.col("dataset") == "kvasir-seg-images", F.lit(False))
    rest = [c for c in rows.columns if c not in ("group", "rel_path")]
    best = rows.groupBy("group").agg(F.min(F.struct((~prefer).alias("_late"), "rel_path", *rest)).alias("_x"))
    return best.select("group", *[F.col(f"_x.{c}").alias(c) for c in ("rel_path", *rest)])
