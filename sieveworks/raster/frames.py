"""Raster operators over DataFrames of images and pixels."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.functions.scalars import hash_order, stem
from sieveworks.operators.ranks import hash_rank
from sieveworks.raster import filters, masks

KIND = "id bigint, operator string, level int, height int, width int, pixels binary"


def sweep_table(spark: SparkSession, sweep: dict | None = None) -> DataFrame:
    """Operator, level, params (JSON); a closed table."""
    rows = [(op, i, json.dumps(p)) for op, levels in (sweep or filters.SWEEP).items() for i, p in enumerate(levels)]
    return spark.createDataFrame(rows, "operator string, level int, params string")


def degraded(images: DataFrame, sweep: DataFrame) -> DataFrame:
    """Every image under every operator and level; pixels are null where the operator refused.

    images: id, height, width, pixels (RGB bytes by rows), mask (bytes of
    height * width, above 127 is inside; may be null). The sweep is a small
    closed table. The level seeds the operator. Null pixels, or pixels that
    don't fit the size, give null pixels.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                done = None
                if r.pixels is not None and len(r.pixels) == r.height * r.width * 3 > 0:
                    img = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3) / 255.0
                    mask = None if r.mask is None else masks.as_mask(np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width))
                    done = filters.degrade(r.operator, img, json.loads(r.params), mask, int(r.level))
                out.append(None if done is None else filters.quantise(done).tobytes())
            yield pdf[["id", "operator", "level", "height", "width"]].assign(pixels=pd.Series(out, dtype=object, index=pdf.index))

    return images.crossJoin(F.broadcast(sweep)).mapInPandas(run, KIND)


def panel_key(degraded_rows: DataFrame, names: DataFrame, sweep: DataFrame) -> DataFrame:
    """panel_id, image, operator, level, params of every panel that was not refused.

    names: id, image. Panels of one image (as many as the sweep has rows at
    most) are numbered from 0 by operator and level, behind the image's stem.
    """
    done = degraded_rows.where("pixels is not null").select("id", "operator", "level").join(F.broadcast(sweep), ["operator", "level"]).join(names, "id")
    number = F.row_number().over(W.partitionBy("id").orderBy("operator", "level")) - 1
    return done.select(F.concat(stem(F.col("image")), F.lit("_"), F.lpad(number.cast("string"), 3, "0")).alias("panel_id"), "image", "operator", "level", "params")


def rating_form(key: DataFrame, seed: int = 0) -> DataFrame:
    """The panels in blinded order (position from 1, by a digest), with empty fields for the rater, and without what was done to them."""
    ordered = hash_rank(key.select("panel_id", "image", F.lit(0).alias("_all"), hash_order(seed, F.col("panel_id"), F.col("image")).alias("_h")), ["_all"], "_h", "panel_id", "position")
    return ordered.select("position", "panel_id", "image", *[F.lit("").alias(c) for c in ("identifiable", "rater", "notes")])


def from_spark_images(df: DataFrame) -> DataFrame:
    """path, height, width, pixels (RGB) from the frames of Spark's image source, which holds BGR; others than 3 channels give null."""

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.uint8).reshape(-1, 3)[:, ::-1].tobytes() if c == 3 else None for d, c in zip(data, channels, strict=True)], dtype=object)

    return df.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), rgb("image.data", "image.nChannels").alias("pixels"))


def mask_facts(df: DataFrame) -> DataFrame:
    """Id, area, cy, cx, components, region of masks given as id, height, width, mask (bytes); a null mask gives nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.mask is None or len(r.mask) != r.height * r.width or not len(r.mask):
                    rows.append((r.id, None, None, None, None, None))
                    continue
                m = masks.as_mask(np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width))
                area, cy, cx, _, _ = masks.stats(m)
                n, _, where = masks.facts(m)
                rows.append((r.id, area, cy, cx, n, where))
            out = pd.DataFrame(rows, columns=["id", "area", "cy", "cx", "components", "region"])
            out["components"] = out["components"].astype("Int32")
            yield out

    return df.mapInPandas(run, "id bigint, area double, cy double, cx double, components int, region string")


def low_light(x: Column, gain: float, gamma: float = 1.0) -> Column:
    """L3 and L9 on a column of values in 0..1: bytes, inside the JVM."""
    v = F.pow(F.pow(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)), F.lit(filters.GAMMA)) * gain, F.lit(1.0 / (filters.GAMMA * gamma)))
    return F.floor(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)) * 255 + 0.5).cast("int")


def pixels(df: DataFrame, id_col: str, values: str, width: int) -> DataFrame:
    """id, y, x, v: a flat array of values as a long table."""
    long = df.select(F.col(id_col).alias("id"), F.posexplode(values).alias("i", "v"))
    return long.select("id", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def pixel_stats(px: DataFrame, width: int, height: int) -> DataFrame:
    """L12, L13 over a long table (v > 0 is inside): area, inclusive box and quadrant per id; empty masks give area 0 and nulls."""
    inside = F.col("v") > 0
    g = px.groupBy("id").agg(*[f(F.when(inside, F.col(c))).alias(n) for n, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"), ("cx", F.avg, "x"), ("cy", F.avg, "y"))], F.round(F.count_if(inside) / (width * height), 6).alias("area"))
    quadrant = F.concat(F.when(F.col("cy") < height / 2, "top").otherwise("bottom"), F.lit("-"), F.when(F.col("cx") < width / 2, "left").otherwise("right"))
    return g.select("id", "area", F.concat_ws(",", *[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")]).alias("bbox"), F.when(F.col("cx").isNotNull(), quadrant).alias("quadrant"))


def pixel_dilation(px: DataFrame, width: int, height: int, radius: int) -> DataFrame:
    """L11 over a long table: id and the number of pixels within the radius of its mask.

    Every inside pixel names its neighbours by a fixed list of offsets, so
    that no join of pixels is needed.
    """
    near = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    to = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in near])).alias("p")
    grown = px.where(F.col("v") > 0).select("id", to).select("id", "p.y", "p.x").where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()
    return px.select("id").distinct().join(grown.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("pixels"))
