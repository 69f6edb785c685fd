"""Groups of files that are copies or near-copies, directly or through others, and their profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.normal import code64, hex_digest
from sieveworks.operators.components import components
from sieveworks.operators.hamming import code_classes, near_classes
from sieveworks.session import cut

THRESHOLD = 4
SWEEP = [0, 2, 4, 6, 8, 10, 12]


def hashed_files(inventory: DataFrame) -> DataFrame:
    """One row per file with both hashes: rel_path, dataset, class_label, sha, ph, dh (of repeated scans the least values).

    The codes are those of a scan that has both; a scan that lacks one hides no other.
    """
    rows = inventory.select("rel_path", "dataset", "class_label", hex_digest("sha256").alias("sha"), code64("phash").alias("ph"), code64("dhash").alias("dh"))
    one = rows.groupBy("rel_path").agg(*[F.min(c).alias(c) for c in ("dataset", "class_label", "sha")], F.min(F.when(F.col("ph").isNotNull() & F.col("dh").isNotNull(), F.struct("ph", "dh"))).alias("x"))
    return one.where("x is not null").select("rel_path", "dataset", "class_label", "sha", "x.ph", "x.dh")


def near_dup(files: DataFrame, threshold: int = THRESHOLD, dual: bool = True) -> DataFrame:
    """Pairs of class representatives within the threshold."""
    codes = ["ph", "dh"] if dual else ["ph"]
    return near_classes(code_classes(files, "rel_path", codes), threshold, "ph", "dh" if dual else None)


def class_members(files: DataFrame, dual: bool = True) -> DataFrame:
    """rel_path and the representative of its class of equal codes."""
    codes = ["ph", "dh"] if dual else ["ph"]
    return files.join(code_classes(files, "rel_path", codes).drop("n"), codes).select("rel_path", "rep")


def copies(files: DataFrame) -> DataFrame:
    """Members to the representatives of their classes, and files to the first of equal digest."""
    classes = code_classes(files, "rel_path", ["ph", "dh"]).where("n > 1").drop("n")
    same = files.join(classes, ["ph", "dh"]).select(F.col("rep").alias("a"), F.col("rel_path").alias("b"))
    firsts = files.where("sha is not null").groupBy("sha").agg(F.min("rel_path").alias("a"), F.count("*").alias("n")).where("n > 1")
    exact = files.join(firsts, "sha").select("a", F.col("rel_path").alias("b"))
    return same.unionByName(exact).where("a <> b")


def edges(files: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Near pairs of representatives, members to representatives, and files to the first of equal digest."""
    return near_dup(files, threshold).select("a", "b").unionByName(copies(files))


def group_map(inventory: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """rel_path, dataset, class_label and group (least path of the component); a file alone is its own group."""
    files = cut(hashed_files(inventory))
    comp = components(files.select(F.col("rel_path").alias("id")), edges(files, threshold))
    return files.join(comp.withColumnRenamed("id", "rel_path"), "rel_path").select("rel_path", "dataset", "class_label", F.col("component").alias("group"))


def linked_keys(inventory: DataFrame, keys: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """J2 over files with and without hashes: rel_path and group (least key of the component).

    keys: rel_path, key; files of one key are exact copies, and keys with near
    copies within the threshold in both hashes are linked. Files without hashes
    are linked by their key alone.
    """
    files = cut(hashed_files(inventory).select("rel_path", "ph", "dh").join(keys, "rel_path").select("key", "ph", "dh"))
    classes = code_classes(files, "key", ["ph", "dh"])
    copied = files.join(classes.where("n > 1").drop("n"), ["ph", "dh"]).select(F.col("rep").alias("a"), F.col("key").alias("b"))
    links = near_classes(classes, threshold, "ph", "dh").select("a", "b").unionByName(copied.where("a <> b"))
    comp = components(keys.select(F.col("key").alias("id")), links)
    return keys.join(comp.withColumnRenamed("id", "key"), "key").select("rel_path", F.col("component").alias("group"))


def profile(groups: DataFrame) -> DataFrame:
    """F8: one row over all groups."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("images"), F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_multi"), F.max("n").alias("largest"))


def _sized(sizes: DataFrame, *by: str) -> DataFrame:
    """groups, multi, in_multi and largest over rows with the size ``n`` of a group."""
    many = F.col("n") > 1
    return sizes.groupBy(*by).agg(F.count("*").alias("groups"), F.count_if(many).alias("multi"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("in_multi"), F.max("n").alias("largest"))


def size_distribution(groups: DataFrame) -> DataFrame:
    """how many groups have each size."""
    return groups.groupBy("group").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def largest(groups: DataFrame, k: int = 10, examples: int = 4) -> DataFrame:
    """The k largest groups of two or more, their classes with counts and first paths (both as text).

    The first paths are found one by one, each as a minimum beyond the one
    before it, so that no task holds a group; k rows at most are broadcast.
    """
    top = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "group").limit(k)
    rows = groups.join(F.broadcast(top), "group")
    classes = rows.groupBy("group", "n", F.coalesce("class_label", F.lit("(none)")).alias("c")).agg(F.count("*").alias("m")).groupBy("group", "n").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "c", "m"))), ",").alias("classes"))
    first, rest = None, rows.select("group", "rel_path")
    for _ in range(examples):
        least = rest.groupBy("group").agg(F.min("rel_path").alias("p"))
        first = least if first is None else first.unionByName(least)
        rest = rest.join(F.broadcast(least.withColumnRenamed("p", "_p")), "group").where(F.col("rel_path") > F.col("_p")).drop("_p")
    first = first.groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("paths"))
    return classes.join(first, "group")


def class_collapse(groups: DataFrame) -> DataFrame:
    """images, groups and the share of images that fold away, per class."""
    g = groups.groupBy(F.coalesce("class_label", F.lit("(none)")).alias("class_label")).agg(F.count("*").alias("images"), F.countDistinct("group").alias("groups"))
    return g.withColumn("collapse_pct", F.round(100 * (1 - F.col("groups") / F.col("images")), 3))


def threshold_sweep(inventory: DataFrame, thresholds: list[int] | None = None) -> DataFrame:
    """Pairs, groups, multi, in_multi and largest at each threshold.

    Class pairs are found once at the greatest threshold. A pair of classes
    stands for n_a * n_b pairs of files, a class for n * (n - 1) / 2. Copies are
    linked once; only what near pairs link beyond them is linked again, for all
    thresholds in the same rounds.
    """
    ts = sorted(set(SWEEP if thresholds is None else thresholds))
    spark = inventory.sparkSession
    files = cut(hashed_files(inventory))
    near = near_dup(files, max(ts))
    start = cut(components(files.select(F.col("rel_path").alias("id")), copies(files)))
    sizes = start.groupBy("component").agg(F.count("*").alias("n"))
    of = lambda c: start.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    near = cut(near.hint("merge").join(of("a"), "a").hint("merge").join(of("b"), "b").select("c_a", "c_b", (F.col("n_a") * F.col("n_b")).alias("pairs"), "dist"))
    ends = near.select(F.col("c_a").alias("component")).unionByName(near.select(F.col("c_b").alias("component"))).distinct()
    moved = cut(sizes.join(ends, "component"))
    still = _sized(sizes.join(ends, "component", "left_anti"))
    steps = F.broadcast(spark.createDataFrame([(t,) for t in ts], "threshold int"))
    at = lambda c: F.concat_ws(":", F.lpad(F.col("threshold").cast("string"), 2, "0"), c)
    links = near.crossJoin(steps).where(F.col("dist") <= F.col("threshold"))
    comp = components(moved.crossJoin(steps).select(at("component").alias("id")), links.select(at("c_a").alias("a"), at("c_b").alias("b")))
    comp = comp.select(F.substring("id", 1, 2).cast("int").alias("threshold"), F.expr("substring(id, 4)").alias("was"), F.col("component").alias("group"))
    grown = comp.join(moved.withColumnRenamed("component", "was"), "was").groupBy("threshold", "group").agg(F.sum("n").alias("n"))
    parts = _sized(grown, "threshold").unionByName(still.crossJoin(steps))
    parts = parts.groupBy("threshold").agg(F.sum("groups").alias("groups"), F.sum("multi").alias("multi"), F.sum("in_multi").alias("in_multi"), F.max("largest").alias("largest"))
    across = links.groupBy("threshold").agg(F.sum("pairs").alias("across"))
    inner = code_classes(files, "rel_path", ["ph", "dh"]).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("inner"))
    return parts.join(across, "threshold", "left").join(F.broadcast(inner)).select("threshold", (F.coalesce("across", F.lit(0)) + F.col("inner")).alias("pairs"), "groups", "multi", "in_multi", "largest")
