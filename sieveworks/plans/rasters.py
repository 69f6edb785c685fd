"""Raster queries; the 64 floats of an embedding play an 8 by 8 image."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sieveworks.raster import filters, frames, masks
from sieveworks.session import cut, table

SIDE = 8


def _px(spark, d):
    return frames.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", SIDE)


def mask_stats(spark, d):
    return frames.pixel_stats(_px(spark, d), SIDE, SIDE)


def mask_dilate(spark, d):
    return frames.pixel_dilation(_px(spark, d), SIDE, SIDE, 2)


def low_illumination(spark, d):
    p = _px(spark, d).select("id", frames.low_light(F.abs("v"), 0.25).alias("b"))
    return p.groupBy("id").agg(F.sum("b").alias("total"), F.max("b").alias("brightest"))


def fov_crop_keep(spark, d):
    """Share of each mask that a crop to 0.7 keeps; null where the crop is refused."""
    box = filters.crop_box(SIDE, SIDE, 0.7)
    inside = (F.col("v") > 0).cast("int")
    kept = F.col("y").between(box[0].start, box[0].stop - 1) & F.col("x").between(box[1].start, box[1].stop - 1)
    g = _px(spark, d).groupBy("id").agg(F.sum(inside).alias("n"), F.sum(F.when(kept, inside).otherwise(0)).alias("k"))
    return g.select("id", F.when((F.col("n") > 0) & (F.col("k") >= filters.KEEP_MASK * F.col("n")), F.round(F.col("k") / F.col("n"), 6)).alias("kept"))


def corruption_sweep(spark, d):
    """The plan of a sweep: files of each dataset times operators and levels."""
    files = table(spark, d, "inventory").where(F.col("readable") & ~F.col("dataset").endswith("-masks")).select("dataset", "rel_path").distinct()
    return files.crossJoin(F.broadcast(frames.sweep_table(spark))).groupBy("dataset", "operator", "level", "params").agg(F.count("*").alias("panels"))


def _images(spark, d):
    """8 by 8 RGB images (three shifted channels) and the sign mask."""

    @F.pandas_udf("binary")
    def rgb(v: pd.Series) -> pd.Series:
        return pd.Series([filters.quantise(np.stack([np.roll(np.abs(np.asarray(x)) * 3, k) for k in range(3)], 1)).tobytes() for x in v], dtype=object)

    @F.pandas_udf("binary")
    def sign(v: pd.Series) -> pd.Series:
        return pd.Series([((np.asarray(x) > 0) * 255).astype(np.uint8).tobytes() for x in v], dtype=object)

    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), rgb("embedding").alias("pixels"), sign("embedding").alias("mask"))


def raster_degraded(spark, d):
    """Digests of all images under the whole sweep (rows only: the operators are numpy)."""
    out = frames.degraded(_images(spark, d), frames.sweep_table(spark, {**filters.SWEEP, "gaussian_noise": [{"sigma": 0.05}], "jpeg": [{"quality": 20}], "clean": [{}]}))
    return out.select("id", "operator", "level", F.sha2("pixels", 256).alias("digest"))


def rating_form(spark, d):
    """H10 (rows only, as the panels are numpy's): the blinded form of all panels of the sweep that no operator refused."""
    sweep = frames.sweep_table(spark)
    done = cut(frames.degraded(_images(spark, d), sweep).select("id", "operator", "level", F.col("pixels").isNotNull().alias("ok")))
    names = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("frames/v"), F.col("vec_id").cast("string"), F.lit(".png")).alias("image"))
    rows = done.where("ok").withColumn("pixels", F.lit(1))
    return frames.rating_form(frames.panel_key(rows, names, sweep))


def raster_mask_facts(spark, d):
    """Components, area, centroid and region of the largest component of the sign masks."""
    return frames.mask_facts(_images(spark, d))


def raster_controls(spark, d):
    """L16, L17 (rows only): control regions for one bright corner of each image, upsampled to 64 by 64."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                img = np.kron(np.frombuffer(r.pixels, np.uint8).reshape(SIDE, SIDE, 3) / 255.0, np.ones((8, 8, 1)))
                lesion = np.zeros((64, 64), bool)
                lesion[6:16, 8 + r.id % 16 : 18 + r.id % 16] = True
                for kind, c in (("matched", masks.matched_control(img, lesion)), ("random", masks.random_control(img, lesion, np.random.default_rng(r.id)))):
                    rows.append((r.id, kind, c.ok, c.reason, round(c.area, 6), round(c.luminance, 6)))
            yield pd.DataFrame(rows, columns=["id", "kind", "ok", "reason", "area_delta", "luminance_delta"])

    return _images(spark, d).mapInPandas(run, "id bigint, kind string, ok boolean, reason string, area_delta double, luminance_delta double")


_PX = "px AS (SELECT vec_id AS id, (p - 1) // 8 AS y, (p - 1) % 8 AS x, v::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))"
_SWEEP = ", ".join(f"('{op}', {i}, '{json.dumps(p)}')" for op, levels in filters.SWEEP.items() for i, p in enumerate(levels))

SQL = {
    "mask_stats": f"""WITH {_PX}, g AS (SELECT id, round(count(*) FILTER (v > 0) / 64, 6) AS area, min(x) FILTER (v > 0) AS x0, min(y) FILTER (v > 0) AS y0, max(x) FILTER (v > 0) AS x1, max(y) FILTER (v > 0) AS y1, avg(x) FILTER (v > 0) AS cx, avg(y) FILTER (v > 0) AS cy FROM px GROUP BY id)
SELECT id, area, concat_ws(',', x0, y0, x1, y1) AS bbox, CASE WHEN cx IS NOT NULL THEN CASE WHEN cy < 4 THEN 'top' ELSE 'bottom' END || '-' || CASE WHEN cx < 4 THEN 'left' ELSE 'right' END END AS quadrant FROM g""",
    "mask_dilate": f"WITH {_PX} SELECT p.id, count(*) FILTER (EXISTS (SELECT 1 FROM px q WHERE q.id = p.id AND q.v > 0 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2 <= 4)) AS pixels FROM px p GROUP BY p.id",
    "low_illumination": f"WITH {_PX}, b AS (SELECT id, floor(least(greatest(pow(pow(least(abs(v), 1.0), 2.2::DOUBLE) * 0.25::DOUBLE, 1.0::DOUBLE / 2.2::DOUBLE), 0.0), 1.0) * 255 + 0.5)::INTEGER AS b FROM px) SELECT id, sum(b)::BIGINT AS total, max(b) AS brightest FROM b GROUP BY id",
    "fov_crop_keep": f"WITH {_PX}, g AS (SELECT id, count(*) FILTER (v > 0) AS n, count(*) FILTER (v > 0 AND y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5) AS k FROM px GROUP BY id) SELECT id, CASE WHEN n > 0 AND k >= 0.8 * n THEN round(k / n, 6) END AS kept FROM g",
    "raster_mask_facts": f"""WITH RECURSIVE {_PX},
ins AS (SELECT id, y, x, y * 8 + x AS cell FROM px WHERE v > 0),
near AS (SELECT a.id, a.cell, b.cell AS other FROM ins a JOIN ins b ON a.id = b.id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (SELECT id, cell, cell AS seen FROM ins UNION SELECT r.id, r.cell, n.other FROM reach r JOIN near n ON n.id = r.id AND n.cell = r.seen),
lab AS (SELECT id, cell, min(seen) AS c FROM reach GROUP BY id, cell),
comp AS (SELECT id, c, count(*) AS n, avg(cell // 8) / 8 AS cy, avg(cell % 8) / 8 AS cx FROM lab GROUP BY id, c),
top AS (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM comp QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, c) = 1),
g AS (SELECT id, count(*) FILTER (v > 0) / 64 AS area, coalesce(avg(y) FILTER (v > 0) / 8, 0.5) AS cy, coalesce(avg(x) FILTER (v > 0) / 8, 0.5) AS cx FROM px GROUP BY id)
SELECT g.id, g.area::DOUBLE AS area, g.cy::DOUBLE AS cy, g.cx::DOUBLE AS cx, coalesce(t.k, 0)::INTEGER AS components,
  CASE WHEN t.id IS NOT NULL THEN CASE WHEN abs(t.cy - 0.5) <= 0.1667 AND abs(t.cx - 0.5) <= 0.1667 THEN 'centre' ELSE CASE WHEN t.cy < 0.5 THEN 'upper' ELSE 'lower' END || CASE WHEN t.cx < 0.5 THEN ' left' ELSE ' right' END END END AS region
FROM g LEFT JOIN top t USING (id)""",
    "corruption_sweep": f"SELECT dataset, operator, level, params, count(*) AS panels FROM (SELECT DISTINCT dataset, rel_path FROM inventory WHERE readable AND dataset NOT LIKE '%-masks'), (VALUES {_SWEEP}) AS t(operator, level, params) GROUP BY ALL",
}


def queries() -> dict:
    return {f.__name__: f for f in (mask_stats, mask_dilate, low_illumination, fov_crop_keep, corruption_sweep, raster_degraded, rating_form, raster_mask_facts, raster_controls)}
