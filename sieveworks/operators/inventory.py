"""Reports over the file inventory: counts, sizes, image-mask pairing, exact copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.normal import hex_digest
from sieveworks.functions.scalars import class_label, classify, stem
from sieveworks.operators.ranks import percentiles

AREA_LIMIT = 0.40


def classified(inventory: DataFrame) -> DataFrame:
    """rel_path, dataset by the rules, label and stem."""
    rule = classify(F.col("rel_path"))
    return inventory.select("rel_path", rule.alias("rule"), class_label(F.col("rel_path"), rule).alias("label"), stem(F.col("rel_path")).alias("stem"))


def counts(inventory: DataFrame) -> DataFrame:
    """Files and unreadable files per dataset and label (null label kept), as ``dataset/label``."""
    g = inventory.groupBy("dataset", "class_label").agg(F.count("*").alias("files"), F.count_if(~F.col("readable")).alias("unreadable"))
    return g.select(F.concat_ws("/", "dataset", F.coalesce("class_label", F.lit("None"))).alias("key"), "files", "unreadable")


def categories(inventory: DataFrame) -> DataFrame:
    """counts by dataset, format, mode and mask quadrant as (column, value, files)."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("None")).alias("value")) for c in ("dataset", "format", "mode", "mask_centroid_quadrant")]))
    return inventory.select(parts.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("files"))


def dimensions(inventory: DataFrame) -> DataFrame:
    """range of sizes of readable files, distinct sizes, and the volume in GB; nulls if nothing is readable."""
    ok = inventory.where("readable")
    return ok.agg(F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.min("height").alias("min_height"), F.max("height").alias("max_height"), F.countDistinct("width", "height").alias("sizes"), F.bround(F.sum("bytes") / 1e9, 6).alias("gb"))


def top_sizes(inventory: DataFrame, k: int = 10) -> DataFrame:
    """H1: the most common (width, height), ties to the smaller."""
    return inventory.where("readable").groupBy("width", "height").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width", "height").limit(k)


def area_summary(inventory: DataFrame) -> DataFrame:
    """Five-number summary of mask areas (sentinels below 0 left out), and masks above the limit."""
    masks = inventory.where((F.col("mask_area_frac") >= 0) & ~F.isnan("mask_area_frac"))
    five = percentiles(masks, "mask_area_frac", [0.0, 0.25, 0.5, 0.75, 1.0])
    large = masks.agg(F.count_if(F.col("mask_area_frac") > AREA_LIMIT).alias("above_limit"))
    return five.join(F.broadcast(large)).select("n", *[F.round(f"q{i}", 6).alias(x) for i, x in enumerate(("least", "p25", "median", "p75", "greatest"))], "above_limit")


def _side(inventory: DataFrame, dataset: str, name: str) -> DataFrame:
    rows = inventory.where(F.col("dataset") == dataset).select(stem(F.col("rel_path")).alias("stem"), "width", "height")
    return rows.groupBy("stem").agg(F.max("width").alias(f"{name}_w"), F.max("height").alias(f"{name}_h"))


def unpaired(inventory: DataFrame, images: str = "kvasir-seg-images", masks: str = "kvasir-seg-masks") -> DataFrame:
    """Side and stem of images without a mask and of masks without an image, over distinct stems."""
    a, b = _side(inventory, images, "a"), _side(inventory, masks, "b")
    return a.join(b, "stem", "left_anti").select(F.lit("image").alias("side"), "stem").unionByName(b.join(a, "stem", "left_anti").select(F.lit("mask").alias("side"), "stem"))


def mismatched(inventory: DataFrame, images: str = "kvasir-seg-images", masks: str = "kvasir-seg-masks") -> DataFrame:
    """Stems present on both sides whose sizes differ."""
    both = _side(inventory, images, "image").join(_side(inventory, masks, "mask"), "stem")
    return both.where((F.col("image_w") != F.col("mask_w")) | (F.col("image_h") != F.col("mask_h")))


def exact_copies(inventory: DataFrame) -> DataFrame:
    """digest, files, first path of every digest that several files share; the group is not collected."""
    d = inventory.select("rel_path", hex_digest("sha256").alias("sha")).where("sha is not null").distinct()
    return d.groupBy("sha").agg(F.count("*").alias("files"), F.min("rel_path").alias("first_path")).where("files > 1")


def find_masks(images: DataFrame, files: DataFrame) -> DataFrame:
    """rel_path of an image and its mask's path, if a file lies there once every folder ``images`` is ``masks``."""
    parts = F.transform(F.split("rel_path", "/"), lambda p: F.when(p == "images", "masks").otherwise(p))
    want = images.select("rel_path", F.array_join(parts, "/").alias("mask_path"))
    return want.where("mask_path <> rel_path").join(files.select(F.col("rel_path").alias("mask_path")).distinct(), "mask_path").select("rel_path", "mask_path")
