"""Tiny text files of scan workers, line by line, in whatever format each was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.normal import path

_CSV = r'^"((?:[^"]|"")*)",(\d+),(\d+)$'
_BARE = r'^([^",\t{=;]+),(\d+),(\d+)$'
_TSV = r"^([^\t]+)\t(\d+)\t(\d+)$"
_PAIRS = r"^(?:\w+=[^;]*;)+$"


def scan_lines(shards: DataFrame) -> DataFrame:
    """rel_path, run, bytes of every whole line of ``payload``.

    A line is whole if it gives all three and is closed as its format demands:
    a JSON object by its brace, key=value pairs by their last semicolon, and
    fields with commas (path in quotes) or tabs by the end of the line or of
    the file. Headers, remarks, blank lines and broken-off lines give nothing,
    nor do null and empty payloads. Line ends may be of any kind, a byte order
    mark is ignored, and paths are brought to one spelling.
    """
    line = F.explode(F.split(F.regexp_replace("payload", "^﻿", ""), r"\r\n|\n|\r")).alias("line")
    lines = shards.where(F.col("payload").isNotNull()).select(line).where(~F.col("line").rlike(r"^\s*(#|$)"))
    obj = F.from_json(F.when(F.col("line").rlike(r"^\{.*\}\s*$"), F.col("line")), "rel_path string, run string, bytes string")
    part = lambda rx, i: F.regexp_extract("line", rx, i)
    struct = lambda p, r, b: F.struct(p.alias("p"), r.alias("r"), b.alias("b"))
    field = lambda k: F.regexp_extract("line", rf"(?:^|;){k}=([^;]*);", 1)
    found = (
        F.when(F.col("line").startswith("{"), struct(obj["rel_path"], obj["run"], obj["bytes"]))
        .when(F.col("line").rlike(_CSV), struct(F.replace(part(_CSV, 1), F.lit('""'), F.lit('"')), part(_CSV, 2), part(_CSV, 3)))
        .when(F.col("line").rlike(_TSV), struct(part(_TSV, 1), part(_TSV, 2), part(_TSV, 3)))
        .when(F.col("line").rlike(_PAIRS), struct(field("rel_path"), field("run"), field("bytes")))
        .when(F.col("line").rlike(_BARE), struct(part(_BARE, 1), part(_BARE, 2), part(_BARE, 3)))
    )
    out = lines.select(found.alias("x")).select(path("x.p").alias("rel_path"), F.col("x.r").try_cast("int").alias("run"), F.col("x.b").try_cast("bigint").alias("bytes"))
    return out.where((F.col("rel_path") != "") & F.col("run").isNotNull() & F.col("bytes").isNotNull())


def scan_records(shards: DataFrame) -> DataFrame:
    """rel_path, run, bytes: each scan record once, whether or not its file is in an inventory; of copies that differ in bytes the greatest holds."""
    return scan_lines(shards).groupBy("rel_path", "run").agg(F.max("bytes").alias("bytes"))
