"""Many small parquet files into few well-sized ones by copying encoded blocks.

No page is decoded: the body of each file (its row groups and indexes) is
copied as it is, and a new footer lists all row groups with their offsets moved.
Files are merged only with files of the same schema and key-value metadata. Each
merged file is read back (footer only) and its block count and row total are
held against those of its inputs before it gets its final name. The folder of
merged files gets its own name only when all of them are there.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.sources import thrift

MAGIC = b"PAR1"
#: Size from which a merged file is closed.
TARGET_BYTES = 256 << 20
_COPY = 8 << 20


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):  # as Spark spells it: nothing in it is escaped
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_footer(path: str) -> tuple[dict, int]:
    """Footer and length of the body (with the leading magic bytes) of a parquet file."""
    system, p = _fs(path)
    with system.open_input_file(p) as f:
        size = f.size()
        if size < 12:
            raise ValueError(f"{path}: not a parquet file")
        f.seek(size - 8)
        tail = f.read(8)
        n = int.from_bytes(tail[:4], "little")
        if tail[4:] != MAGIC or n > size - 12:
            raise ValueError(f"{path}: not a parquet file")
        f.seek(size - 8 - n)
        return thrift.Reader(f.read(n)).struct(), size - 8 - n


def fingerprint(footer: dict) -> str:
    """Files with equal fingerprints may share a footer: same schema and key-value metadata."""
    parts = [thrift.dump(*footer[i]) if i in footer else b"" for i in (2, 5, 7)]
    return hashlib.sha256(b"|".join(parts)).hexdigest()[:16]


def _moved(group: dict, by: int, ordinal: int) -> dict:
    """A row group whose body lies ``by`` bytes further."""
    shift = lambda s, fields: {k: (t, v + by) if k in fields and (k != 2 or v) else (t, v) for k, (t, v) in s.items()}
    kind, chunks = group[1][1]
    moved = []
    for chunk in chunks:
        c = shift(chunk, (2, 4, 6))
        if 3 in c:
            c[3] = (thrift.STRUCT, shift(c[3][1], (9, 10, 11, 14)))
        moved.append(c)
    out = dict(group)
    out[1] = (thrift.LIST, (kind, moved))
    if 5 in out:
        out[5] = (out[5][0], out[5][1] + by)
    if 7 in out:
        out[7] = (out[7][0], ordinal) if ordinal < 1 << 15 else None
        if out[7] is None:
            del out[7]
    return out


def merge_files(paths: list[str], out: str) -> tuple[int, int]:
    """Blocks and rows of the file made of the given files; raises, and leaves no file, if it does not hold them all.

    Until it is whole it has a name with an underscore before it, which readers of the folder pass over.
    """
    system, target = _fs(out)
    folder, name = os.path.split(target)
    tmp = os.path.join(folder, f"_{name}.{uuid.uuid4().hex}.tmp")
    try:
        blocks, rows = _copied(paths, system, tmp, out)
        system.move(tmp, target)
    finally:
        if system.get_file_info(tmp).is_file:
            system.delete_file(tmp)
    return blocks, rows


def _copied(paths: list[str], system, tmp: str, out: str) -> tuple[int, int]:
    """Blocks and rows of the files, copied into ``tmp`` and read back."""
    import pyarrow.parquet as pq

    groups, rows, footer, seen = [], 0, None, set()
    with system.open_output_stream(tmp) as w:
        w.write(MAGIC)
        at = len(MAGIC)
        for path in paths:
            own, body = read_footer(path)
            seen.add(fingerprint(own))
            if len(seen) > 1:
                raise ValueError(f"{path}: its schema differs from that of the files before it")
            footer = footer or own
            src, p = _fs(path)
            with src.open_input_stream(p) as f:
                f.read(len(MAGIC))
                left = body - len(MAGIC)
                while left:
                    part = f.read(min(_COPY, left))
                    if not part:
                        raise ValueError(f"{path}: it ends early")
                    w.write(part)
                    left -= len(part)
            mine = own[4][1][1] if 4 in own else []
            if (held := sum(g[3][1] for g in mine)) != own[3][1]:
                raise ValueError(f"{path}: its blocks hold {held} rows, not {own[3][1]} as its footer says")
            groups += [_moved(g, at - len(MAGIC), len(groups) + i) for i, g in enumerate(mine)]
            rows += own[3][1]
            at += body - len(MAGIC)
        meta = dict(footer)
        meta[3], meta[4] = (thrift.I64, rows), (thrift.LIST, (thrift.STRUCT, groups))
        raw = thrift.dump_struct(meta)
        w.write(raw + len(raw).to_bytes(4, "little") + MAGIC)
    with system.open_input_file(tmp) as f:
        made = pq.ParquetFile(f).metadata
        if (made.num_row_groups, made.num_rows) != (len(groups), rows):
            raise ValueError(f"{out}: {made.num_row_groups} blocks and {made.num_rows} rows, not {len(groups)} and {rows}")
    return len(groups), rows


def consolidate(spark: SparkSession, source: str, target: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """bin, files, blocks, rows, out: what each merged file below ``target`` was made of.

    Every file below ``source`` goes into exactly one merged file, whatever its
    name, save those that Spark hides (a first letter of _ or .); one that is no
    whole parquet file, or is empty, raises an error rather than being left out,
    and so does a source that can't be listed. The file and row totals of all
    merged files are held against those of all inputs. ``target`` appears only
    when all this holds: the files are made beside it and moved there. A target
    that has files already raises. Files are listed and their footers read in
    parallel; each task fills merged files one after another up to
    ``target_bytes``, so that a task holds the paths of one merged file only. A
    folder without files gives no row and no target. The merge runs at once and
    is not repeated.
    """
    from sieveworks.session import cut

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [read_footer(p)[0] for p in pdf["path"]]
            yield pdf.assign(kind=[fingerprint(f) for f in read], rows=[f[3][1] for f in read])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, open_bins = TaskContext.get().partitionId() << 32, 0, {}
        for pdf in batches:
            bins = []
            for kind, n in zip(pdf["kind"], pdf["length"], strict=True):
                b, used = open_bins.get(kind, (None, 0))
                if b is None or used + n > target_bytes:
                    b, used, made = base + made, 0, made + 1
                open_bins[kind] = (b, used + n)
                bins.append(b)
            yield pdf.assign(bin=bins)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = sorted(pdf["path"])
        name = f"part-{int(pdf['bin'].iloc[0]):016x}.parquet"
        out = os.path.join(target, name)
        system, p = _fs(aside)
        system.create_dir(p, recursive=True)
        blocks, rows = merge_files(paths, os.path.join(aside, name))
        if rows != int(pdf["rows"].sum()):
            raise ValueError(f"{out}: its inputs changed while they were read")
        return pd.DataFrame({"bin": [pdf["bin"].iloc[0]], "files": [len(paths)], "blocks": [blocks], "rows": [rows], "out": [out]})

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    place = hadoop(target)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place) and len(system.listStatus(place)):
        raise FileExistsError(f"{target}: there are files already")
    aside = system.makeQualified(hadoop(f"{target.rstrip('/')}.{uuid.uuid4().hex}.part")).toString()
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="[^_.]*", ignoreMissingFiles=False).load(source).select("path", "length")
    there = len(files._jdf.inputFiles())
    total, n = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    if n != there:  # Spark passes over files of 0 bytes
        raise ValueError(f"{source}: {there - n} of {there} files are empty, so not parquet files")
    if not n:
        return spark.createDataFrame([], "bin bigint, files int, blocks int, rows bigint, out string")
    tasks = int(min(max(1, total // (4 * target_bytes)), 1000))
    listed = cut(files.mapInPandas(footers, "path string, length bigint, kind string, rows bigint"))
    dealt = listed.repartitionByRange(tasks, "path") if tasks > 1 else listed.coalesce(1)
    bins = cut(dealt.mapInPandas(deal, "path string, length bigint, kind string, rows bigint, bin bigint"))
    try:
        merged = cut(bins.groupBy("bin").applyInPandas(merge, "bin bigint, files int, blocks int, rows bigint, out string"))
        have, want = tuple(merged.agg(F.sum("files"), F.sum("rows")).first()), (n, listed.agg(F.sum("rows")).first()[0])
        if have != want:
            raise ValueError(f"the merged files hold {have[0]} files and {have[1]} rows, their inputs {want[0]} and {want[1]}")
        for left in system.globStatus(hadoop(aside, "_*")) or []:  # of tasks that were killed
            system.delete(left.getPath(), False)
        if system.exists(place):
            system.delete(place, False)
        if not system.rename(hadoop(aside), place):
            raise OSError(f"{aside} can't be moved to {target}")
    finally:
        system.delete(hadoop(aside), True)
    return merged
