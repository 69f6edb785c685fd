"""File scans, image probes, tables and configurations as sources."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieveworks.functions.scalars import class_label, classify, stem
from sieveworks.operators.blockcopy import _fs
from sieveworks.raster import masks

# Suffixes of image files.
SUFFIXES = ["jpg", "jpeg", "png", "tif", "tiff", "bmp"]


def relative(path: Column, root: str) -> Column:
    """A2: path below the root, with forward slashes."""
    base = os.path.abspath(root).replace("\\", "/").rstrip("/") if "://" not in root else root.rstrip("/")
    p = F.regexp_replace(path, r"\\", "/")
    return F.regexp_replace(F.substring_index(p, base + "/", -1), "^/+", "")


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """A1, A2, C4: rel_path, bytes (and sha256) of every image file below the root, whatever the case of its suffix; raises if there is none.

    The content is read only if the digest is asked for.
    """
    rx = r"(?i)\.(" + "|".join(SUFFIXES) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(rx))
    out = files.select(relative(F.col("path"), root).alias("rel_path"), F.col("length").alias("bytes"), *([F.sha2("content", 256).alias("sha256")] if content else []))
    if out.isEmpty():
        raise FileNotFoundError(f"no image file below {root}")
    return out


#: First bytes (hex) of the formats, and the modes of frames by their channels.
MAGIC = [("89504E47", "PNG"), ("FFD8FF", "JPEG"), ("424D", "BMP"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF")]
MODES = {1: "L", 3: "RGB", 4: "RGBA"}


def formats(spark: SparkSession, root: str) -> DataFrame:
    """A3: rel_path and format by the first bytes of a file; empty if they are none of the known ones."""
    head = F.hex(F.substring("content", 1, 4))
    name = F.lit("")
    for magic, fmt in reversed(MAGIC):
        name = F.when(head.startswith(magic), fmt).otherwise(name)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(relative(F.col("path"), root).alias("rel_path"), name.alias("format"))


def probe(spark: SparkSession, root: str) -> DataFrame:
    """A3: rel_path, width, height, channels, readable; -1, -1, 0 and false for files that can't be decoded."""
    img = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    ok = F.col("image.width") > 0
    return img.select(relative(F.col("image.origin"), root).alias("rel_path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.when(ok, F.col("image.nChannels")).otherwise(0).alias("channels"), F.coalesce(ok, F.lit(False)).alias("readable"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row per image file of a folder: scan, digest, classification, what a probe tells, perceptual hashes and mask facts.

    rel_path, bytes, sha256, width, height, readable, dataset, class_label,
    mode, format, error (``Type: message``, empty if readable), phash and dhash
    (readable files that are no masks, else empty), mask_area_frac, mask_empty,
    mask_bbox, mask_centroid_quadrant (masks, else null; area -1 and a quadrant
    that starts with ``ERROR`` for a mask that can't be decoded).
    """
    files, seen = scan(spark, root, content=True), probe(spark, root)
    rule = classify(F.col("rel_path"))
    base = files.join(seen, "rel_path", "left").withColumn("dataset", rule).withColumn("class_label", class_label(F.col("rel_path"), F.col("dataset")))
    img = spark.read.format("image").option("recursiveFileLookup", "true").load(root).where("image.width > 0").select(relative(F.col("image.origin"), root).alias("rel_path"), "image")
    is_mask = classify(F.col("rel_path")).endswith("-masks")
    hashes, facts = perceptual_hashes(img.where(~is_mask)), mask_facts(img.where(is_mask))
    mode = F.lit("")
    for channels, name in MODES.items():
        mode = F.when(F.col("channels") == channels, name).otherwise(mode)
    out = base.join(hashes, "rel_path", "left").join(facts, "rel_path", "left").join(formats(spark, root), "rel_path", "left")
    out = out.withColumn("readable", F.coalesce("readable", F.lit(False))).withColumn("mode", mode).drop("channels").fillna("", ["phash", "dhash", "format"])
    out = out.withColumn("format", F.when(F.col("readable"), F.col("format")).otherwise("")).withColumn("error", F.when(F.col("readable"), "").otherwise("DecodeError: not an image that can be read"))
    lost = ~F.col("readable") & F.col("dataset").endswith("-masks")
    out = out.withColumn("mask_area_frac", F.when(lost, -1.0).otherwise(F.col("mask_area_frac"))).withColumn("mask_empty", F.when(lost, False).otherwise(F.col("mask_empty")))
    return out.withColumn("mask_bbox", F.when(lost, "").otherwise(F.col("mask_bbox"))).withColumn("mask_centroid_quadrant", F.when(lost, F.concat(F.lit("ERROR "), "error")).otherwise(F.col("mask_centroid_quadrant")))


def mask_facts(images: DataFrame) -> DataFrame:
    """rel_path, mask_area_frac, mask_empty, mask_bbox, mask_centroid_quadrant of mask frames of Spark's image source (grey above 127 is inside; box and quadrant are empty for an empty mask)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [masks.inventory_stats(masks.as_mask(_grey(r.data, r.h, r.w))) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"rel_path": pdf["rel_path"], "mask_area_frac": [x["area"] for x in rows], "mask_empty": [x["empty"] for x in rows], "mask_bbox": [x["bbox"] or "" for x in rows], "mask_centroid_quadrant": [x["quadrant"] or "" for x in rows]})

    flat = images.select("rel_path", F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "rel_path string, mask_area_frac double, mask_empty boolean, mask_bbox string, mask_centroid_quadrant string")


def component_facts(spark: SparkSession, root: str) -> DataFrame:
    """Stem, components and region of the masks below a folder; masks that can't be decoded give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [masks.facts(masks.as_mask(_grey(r.data, r.h, r.w))) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"stem": pdf["stem"], "components": [n for n, _, _ in found], "region": [where for _, _, where in found]})

    img = spark.read.format("image").option("recursiveFileLookup", "true").load(root).where("image.width > 0")
    path = relative(F.col("image.origin"), root)
    flat = img.where(classify(path).endswith("-masks")).select(stem(path).alias("stem"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "stem string, components int, region string").groupBy("stem").agg(F.max("components").alias("components"), F.max("region").alias("region"))


def _grey(data: bytes, h: int, w: int) -> np.ndarray:
    """Luma of a frame of Spark's image source (BGR, or grey)."""
    a = np.frombuffer(data, np.uint8).reshape(h, w, -1).astype(float)
    return a[:, :, :3] @ [0.114, 0.587, 0.299] if a.shape[2] >= 3 else a[:, :, 0]


def _shrunk(grey: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area average: each target cell is the mean of the source it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        lo = np.maximum(edge[:-1, None], np.arange(n))
        hi = np.minimum(edge[1:, None], np.arange(n) + 1)
        k = np.clip(hi - lo, 0, None)
        return k / k.sum(axis=1, keepdims=True)

    return weights(grey.shape[0], h) @ grey @ weights(grey.shape[1], w).T


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def dhash(grey: np.ndarray) -> str:
    """Signs of the horizontal steps of an 8 by 9 thumbnail."""
    t = _shrunk(grey, 8, 9)
    return _hex(t[:, 1:] > t[:, :-1])


def phash(grey: np.ndarray) -> str:
    """Low frequencies of a 32 by 32 thumbnail against their median."""
    t = _shrunk(grey, 32, 32)
    k = np.cos(np.pi * np.arange(32)[:, None] * (2 * np.arange(32)[None, :] + 1) / 64)
    low = (k @ t @ k.T)[:8, :8]
    return _hex(low > np.median(low))


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """rel_path, phash, dhash of frames of Spark's image source; empty where an image can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p, d = [], []
            for r in pdf.itertuples(index=False):
                if r.data is None or r.h <= 0:
                    p.append("")
                    d.append("")
                    continue
                grey = _grey(r.data, r.h, r.w)
                p.append(phash(grey))
                d.append(dhash(grey))
            yield pd.DataFrame({"rel_path": pdf["rel_path"], "phash": p, "dhash": d})

    flat = images.select("rel_path", F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "rel_path string, phash string, dhash string")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_table(spark: SparkSession, base: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """A4: base/name.parquet, else base/name.csv (with the schema, if given); raises if neither is there."""
    if exists(spark, f"{base}/{name}.parquet"):
        return spark.read.schema(schema).parquet(f"{base}/{name}.parquet") if schema else spark.read.parquet(f"{base}/{name}.parquet")
    if exists(spark, f"{base}/{name}.csv"):
        reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(f"{base}/{name}.csv")
    raise FileNotFoundError(f"neither {name}.parquet nor {name}.csv lies in {base}")


def load_config(path: str) -> dict:
    """A5: a YAML or JSON configuration, from any file system."""
    system, p = _fs(path)
    with system.open_input_file(p) as f:
        text = f.read().decode("utf-8")
    if path.endswith(".json"):
        import json

        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def image_mask_pairs(images: DataFrame, files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """N images in hash order with the first of three candidate masks that exists and is another file.

    Candidates: the path with its folders ``images`` named ``masks``, and that
    path with the suffixes png and jpg.
    """
    from sieveworks.functions.scalars import hash_order

    parts = F.transform(F.split("rel_path", "/"), lambda p: F.when(p == "images", "masks").otherwise(p))
    twin = F.array_join(parts, "/")
    cands = [twin, F.regexp_replace(twin, r"\.[^./]*$", ".png"), F.regexp_replace(twin, r"\.[^./]*$", ".jpg")]
    tries = images.select("rel_path", F.posexplode(F.array(*cands)).alias("k", "mask_path")).where("mask_path <> rel_path")
    found = tries.join(files.select(F.col("rel_path").alias("mask_path")).distinct(), "mask_path").groupBy("rel_path").agg(F.min_by("mask_path", "k").alias("mask_path"))
    return found.orderBy(hash_order(seed, F.col("rel_path")), "rel_path").limit(n)
