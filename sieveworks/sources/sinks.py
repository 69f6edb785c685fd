"""Sinks: parquet, CSV, JSON summaries, Markdown sheets, and writes that depend on checks."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.operators.blockcopy import _fs
from sieveworks.operators.pools import require


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """B1."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def flat(df: DataFrame, sep: str = "|") -> DataFrame:
    """C14: arrays as joined strings other nested values as JSON and intervals as text, for formats without such types."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.array_join(c, sep) if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string") if kind.startswith("interval") else c).alias(name))
    return df.select(*out)


def unflat(df: DataFrame, lists: list[str], sep: str = "|") -> DataFrame:
    """C14, the other way: joined strings as arrays again; an empty string is an empty array."""
    split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\\Q" + sep + "\\E"))
    return df.select(*[split(c).alias(c) if c in lists else F.col(f"`{c}`") for c in df.columns])


def write_table(df: DataFrame, base: str, stem: str) -> str:
    """B1: base/stem.parquet, or base/stem.csv if a column has a type that parquet can't hold; the path written."""
    try:
        write_parquet(df, f"{base}/{stem}.parquet")
        return f"{base}/{stem}.parquet"
    except Exception as e:  # noqa: BLE001 - only the one about types is met here
        if "UNSUPPORTED_DATA_TYPE" not in str(e) and "does not support the column" not in str(e):
            raise
        write_csv(df, f"{base}/{stem}.csv")
        return f"{base}/{stem}.csv"


def write_csv(df: DataFrame, path: str) -> None:
    """B2: with a header; quotes in values are doubled."""
    flat(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def summary(**frames: DataFrame) -> dict:
    """A nested dict of small aggregates: one-row frames become objects, others lists of objects."""
    out = {}
    for name, df in frames.items():
        rows = [r.asDict(recursive=True) for r in df.collect()]
        out[name] = rows[0] if len(rows) == 1 else rows
    return out


def write_json(doc: dict, path: str) -> None:
    """B3."""
    write_text(json.dumps(doc, indent=2, default=str, ensure_ascii=False), path)


def write_text(text: str, path: str) -> None:
    """A small document, on any file system; its folder is made if it is missing."""
    system, p = _fs(path)
    system.create_dir(os.path.dirname(p), recursive=True)
    with system.open_output_stream(p) as f:
        f.write(text.encode("utf-8"))


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A review sheet of a small aggregate; more than ``limit`` rows raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{title}: more than {limit} rows")
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def write_whole(df: DataFrame, path: str) -> None:
    """A table that is there as a whole or not at all: written beside its place, then moved over what was there."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path))
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(aside)
        system.delete(old, True)
        if not system.rename(new, old):
            raise OSError(f"{aside} can't be moved to {path}")
    finally:
        system.delete(new, True)


def write_checked(df: DataFrame, path: str, checks: DataFrame) -> None:
    """Write, as a whole, only if every violation count is 0."""
    require(checks)
    write_whole(df, path)
