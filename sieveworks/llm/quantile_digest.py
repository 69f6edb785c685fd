"""Problem 2: percentiles with a deterministic rank error from digests that can be merged.

A value is quantised to one of 2**LEVELS ordered cells (relative width EPS).
A digest holds counts of nodes of the dyadic tree over the cells: (level, node)
covers the cells from node << level to ((node + 1) << level) - 1. Compression
moves a node's count to its parent while the family (node, sibling, parent)
holds at most floor(n / K). Digests merge by adding counts of equal nodes.

Error bound: a count moves up LEVELS times at most, each ancestor of a cell
holds at most n / K, so a rank is off by at most n * LEVELS / K for one digest,
and, as errors add up like sizes do, for a merger of digests too. The value is
the upper edge of a cell: up to EPS (relative) or X0 * EPS (near 0) above the
data's own value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 17
EPS = 5e-4
X0 = 1e-4
#: Compression: LEVELS / K is the bound of the relative rank error (0.5 %).
K = 3400
_STEP = math.log1p(EPS)


def cell(x: Column) -> Column:
    """Cell of a value that is at least 0; the order of values is kept. Values beyond the universe (about 1e24) share the last cell."""
    return F.least(F.floor(F.log1p(x / X0) / _STEP), F.lit((1 << LEVELS) - 1)).cast("int")


def upper_edge(cells: np.ndarray) -> np.ndarray:
    return X0 * np.expm1((np.asarray(cells, dtype=np.float64) + 1) * _STEP)


def compress(level: np.ndarray, node: np.ndarray, count: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same digest with nodes moved up where their family holds at most floor(n / k)."""
    bound = int(count.sum()) // k
    if bound == 0:
        return level, node, count
    keep: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    up_n, up_c = np.empty(0, np.int64), np.empty(0, np.int64)
    for lv in range(LEVELS + 1):
        at = level == lv
        ids, inv = np.unique(np.concatenate([node[at], up_n]), return_inverse=True)
        sums = np.bincount(inv, np.concatenate([count[at], up_c]), len(ids)).astype(np.int64)
        if lv == LEVELS:
            keep.append((np.full(len(ids), lv), ids, sums))
            up_n, up_c = np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        parents, pinv = np.unique(ids >> 1, return_inverse=True)
        own = level == lv + 1
        held = pd.Series(count[own]).groupby(node[own]).sum().reindex(parents, fill_value=0).to_numpy() if own.any() else 0
        moves = (np.bincount(pinv, sums, len(parents)) + held <= bound)[pinv]
        keep.append((np.full((~moves).sum(), lv), ids[~moves], sums[~moves]))
        up_n, up_c = ids[moves] >> 1, sums[moves]
    lv, nd, ct = (np.concatenate(x) for x in zip(*keep, strict=True))
    return lv.astype(np.int32), nd.astype(np.int64), ct.astype(np.int64)


def digests(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """One digest (rows by..., level, node, n) per combination of ``by``; null is a value of its own there.

    Cells are counted inside the JVM with partial aggregation, so that a hot
    group moves at most 2**LEVELS counts a task; compression then sees at most
    that many counts of a group, whatever the number of its rows. Null values
    are left out; a table without rows gives no digest.
    """
    leaves = df.where(F.col(value).isNotNull()).withColumn("node", cell(F.col(value)).cast("long")).groupBy(*by, "node").agg(F.count("*").alias("n")).withColumn("level", F.lit(0))
    return _compressed(leaves, by)


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Digests over ``by`` from digests of finer parts, by addition of equal nodes."""
    return _compressed(parts.groupBy(*by, "level", "node").agg(F.sum("n").alias("n")), by)


def _compressed(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Every group compressed; a task sees its groups one after another and holds one group and a batch of rows."""
    kinds = dict(nodes.dtypes)
    cols = [*by, "level", "node", "n"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", level int, node bigint, n bigint"

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = np.flatnonzero(_new_group(pdf, by))
        totals = np.add.reduceat(pdf["n"].to_numpy(), starts)
        ends = np.append(starts[1:], len(pdf))
        large = np.flatnonzero(totals >= K)
        if not len(large):
            return pdf
        parts = [pdf[np.repeat(totals < K, ends - starts)]]  # below K rows nothing can be moved up
        for i in large:
            part = pdf.iloc[starts[i] : ends[i]]
            lv, nd, ct = compress(part["level"].to_numpy(), part["node"].to_numpy(), part["n"].to_numpy())
            parts.append(part.iloc[[0] * len(lv)].assign(level=lv, node=nd, n=ct))
        return pd.concat(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(pdf):
                last = np.flatnonzero(_new_group(pdf, by))[-1]
                if last:
                    yield done(pdf.iloc[:last])
                held = pdf.iloc[last:]
        if held is not None and len(held):
            yield done(held)

    sorted_ = nodes.select(*[F.col(c).cast("int").alias(c) if c == "level" else F.col(c) for c in cols]).repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by)
    return sorted_.mapInPandas(run, schema)


def _new_group(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """True at each row whose group differs from that of the row before; nulls are equal."""
    out = np.zeros(len(pdf), bool)
    out[0] = True
    for c in by:
        now, null = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
        with np.errstate(invalid="ignore"):
            out[1:] |= ((now[1:] != now[:-1]) & ~(null[1:] & null[:-1])) | (null[1:] != null[:-1])
    return out


def percentiles(digest: DataFrame, by: list[str], qs: list[float]) -> DataFrame:
    """by..., q, value, n, rank_error: the value at rank ceil(q * n), off by at most rank_error ranks."""
    kinds = dict(digest.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", q double, value double, n bigint, rank_error bigint, value_error double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lv, nd, ct = (pdf[c].to_numpy(dtype=np.int64) for c in ("level", "node", "n"))
        last = ((nd + 1) << lv) - 1
        order = np.lexsort((lv, last))
        total, run = int(ct.sum()), np.cumsum(ct[order])
        pos = [int(np.searchsorted(run, max(1, math.ceil(q * total - 1e-9)))) for q in qs]
        out = pd.DataFrame({"q": qs, "value": upper_edge(last[order][pos]), "n": total, "rank_error": total * LEVELS // K, "value_error": EPS})
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
            out[c] = out[c].astype(pdf[c].dtype)
        return out

    return digest.groupBy(*by).applyInPandas(one, schema)
