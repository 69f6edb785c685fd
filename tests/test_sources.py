"""File sources, sinks and streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks import jobs
from sieveworks.sources import files, sinks
from sieveworks.streaming import arrivals


def png(path, rgb):
    h, w, _ = rgb.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_inventory_of_a_folder(spark, tmp_path):
    r = np.random.default_rng(0)
    smooth = np.repeat(np.linspace(0, 200, 40)[None, :, None], 30, 0).repeat(3, 2).astype(np.uint8)
    png(tmp_path / "kvasir-seg/images/a.png", smooth)
    png(tmp_path / "labeled-images/lower/cecum/B.PNG", r.integers(0, 255, (20, 24, 3)).astype(np.uint8))
    png(tmp_path / "kvasir-seg/masks/a.png", smooth)
    (tmp_path / "labeled-images/lower/cecum/bad.jpg").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    inv = {x["rel_path"]: x for x in files.inventory(spark, str(tmp_path)).collect()}
    assert set(inv) == {"kvasir-seg/images/a.png", "labeled-images/lower/cecum/B.PNG", "kvasir-seg/masks/a.png", "labeled-images/lower/cecum/bad.jpg"}
    a, bad = inv["kvasir-seg/images/a.png"], inv["labeled-images/lower/cecum/bad.jpg"]
    assert (a["width"], a["height"], a["readable"], a["dataset"]) == (40, 30, True, "kvasir-seg-images") and len(a["phash"]) == len(a["dhash"]) == 16
    assert a["dhash"] == "f" * 16 and a["sha256"] == __import__("hashlib").sha256((tmp_path / "kvasir-seg/images/a.png").read_bytes()).hexdigest()
    assert (bad["width"], bad["readable"], bad["phash"]) == (-1, False, "") and inv["kvasir-seg/masks/a.png"]["phash"] == ""
    assert inv["labeled-images/lower/cecum/B.PNG"]["class_label"] == "cecum"
    assert (a["mode"], a["format"], a["error"], a["mask_area_frac"]) == ("RGB", "PNG", "", None) and (bad["mode"], bad["format"]) == ("", "") and bad["error"].startswith("DecodeError: ")
    m = inv["kvasir-seg/masks/a.png"]
    inside = smooth[:, :, 0] > 127
    assert m["mask_area_frac"] == pytest.approx(inside.mean(), abs=1e-6) and m["mask_bbox"] == f"{int(inside[0].argmax())},0,39,29" and m["mask_centroid_quadrant"] == "top-right" and not m["mask_empty"]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none/x.txt").write_text("x")
        files.scan(spark, str(tmp_path / "none"))
    all_ = spark.createDataFrame([(p,) for p in inv], "rel_path string")
    assert [tuple(x) for x in files.image_mask_pairs(all_.where("rel_path like '%images/a%'"), all_, 5).collect()] == [("kvasir-seg/images/a.png", "kvasir-seg/masks/a.png")]


def test_tables_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": 1.0}, 'x "q", y'), (2, None, None, None)], "id int, opts array<string>, m map<string,double>, t string")
    sinks.write_csv(df, str(tmp_path / "t.csv"))
    back = files.load_table(spark, str(tmp_path), "t", "id int, opts string, m string, t string").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, "a|b", '{"k":1.0}', 'x "q", y'), (2, None, None, None)]
    sinks.write_parquet(df, str(tmp_path / "t.parquet"))
    assert files.load_table(spark, str(tmp_path), "t").count() == 2
    with pytest.raises(FileNotFoundError):
        files.load_table(spark, str(tmp_path), "nothing")
    sinks.write_json(sinks.summary(one=df.agg(F.count("*").alias("n")), rows=df.select("id")), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"one": {"n": 2}, "rows": [{"id": 1}, {"id": 2}]}
    assert "| 1 |" in sinks.markdown(df.select("id"), "T")
    (tmp_path / "c.yaml").write_text("a: [1, 2]\n")
    assert files.load_config(str(tmp_path / "c.yaml")) == {"a": [1, 2]}


def test_lists_survive_flat_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b c"]), (2, []), (3, None)], "id int, opts array<string>")
    assert [tuple(r) for r in sinks.unflat(sinks.flat(df), ["opts"]).orderBy("id").collect()] == [(1, ["a", "b c"]), (2, []), (3, None)]
    assert sinks.write_table(df, str(tmp_path), "t").endswith("t.parquet")
    odd = df.selectExpr("id", "make_interval(0, 0, 0, id) as span", "opts")
    assert sinks.write_table(odd, str(tmp_path), "u").endswith("u.csv") and files.load_table(spark, str(tmp_path), "u").count() == 3


def test_jobs(spark, tmp_path):
    r = np.random.default_rng(5)
    root, man = tmp_path / "images", str(tmp_path / "manifests")
    blob = lambda y, x: np.where(((np.mgrid[:48, :64][0] - y) ** 2 + (np.mgrid[:48, :64][1] - x) ** 2 <= 64)[:, :, None], 255, 0).repeat(3, 2).astype(np.uint8)
    for i in range(12):
        frame = r.integers(0, 255, (48, 64, 3)).astype(np.uint8)
        png(root / f"kvasir-seg/images/p{i}.png", frame)
        png(root / f"kvasir-seg/masks/p{i}.png", blob(12 + 2 * i, 20 + 2 * i))
        png(root / f"labeled-images/lower/cecum/n{i}.png", r.integers(0, 255, (48, 64, 3)).astype(np.uint8))
        png(root / f"labeled-images/lower/ileum/x{i}.png", r.integers(0, 255, (48, 64, 3)).astype(np.uint8))
    png(root / "labeled-images/lower/polyps/twin.png", np.frombuffer(zlib.decompress(_idat(root / "kvasir-seg/images/p3.png")), np.uint8).reshape(48, -1)[:, 1:].reshape(48, 64, 3))
    (root / "labeled-images/lower/cecum/bad.png").write_bytes(b"broken")
    assert jobs.scan_job(spark, str(root), man)["masks"]["n"] == 12
    assert jobs.group_job(spark, man)["profile"]["images"] == 37
    jobs.split_job(spark, man)
    splits = spark.read.parquet(f"{man}/splits.parquet")
    assert splits.count() == 25 and splits.where("split is null or pool = 'too_few'").count() == 0
    assert splits.where("rel_path like '%p3.png' or rel_path like '%twin.png'").select("group", "split").distinct().count() == 1
    jobs.bank_job(spark, str(root), man)
    items = spark.read.parquet(f"{man}/question_bank.parquet")
    assert {x["question_type"] for x in items.select("question_type").distinct().collect()} == {"A", "B", "C1", "C2", "D"} - {"C2"} | {x["question_type"] for x in items.where("question_type = 'C2'").select("question_type").distinct().collect()}
    assert items.where("template_id = 'location' and question_type = 'A'").count() == 12 and items.where("question_type = 'B'").select("question_text").distinct().count() > 3
    assert (tmp_path / "manifests/question_bank_review.md").read_text().startswith("# Templates")
    before = splits.count()
    with pytest.raises(ValueError, match="nothing is written"):
        sinks.write_checked(splits.limit(1), f"{man}/splits.parquet", jobs.split_checks(splits.withColumn("split", F.when(F.col("rel_path").like("%twin.png"), "elsewhere").otherwise(F.col("split")))))
    assert spark.read.parquet(f"{man}/splits.parquet").count() == before and not list((tmp_path / "manifests").glob("*.part"))
    with pytest.raises(SystemExit):
        jobs.main(["bank", "--manifests", man])


def _idat(path):
    data = path.read_bytes()
    at = data.index(b"IDAT")
    return data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.sql("select concat('i', id % 3) as item_id, timestamp'2026-01-01 10:00:00' + make_interval(0, 0, 0, cast(id % 3 as int)) as timestamp, 'Model-A' as model, id % 2 = 0 as unsafe from range(9)")
    df.write.parquet(src)
    stream = arrivals.first_deliveries(arrivals.record_stream(spark, src, df.schema))
    arrivals.write_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = arrivals.daily_counts(arrivals.record_stream(spark, src, df.schema)).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("daily").count() == 3 and spark.table("daily").agg(F.sum("records")).first()[0] == 9
