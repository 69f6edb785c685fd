"""Joins of 64-bit codes within a Hamming distance, as equi-joins on bit bands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.session import cut

#: Classes that share a band of the first code beyond which bands of the second deal them too. Comparisons of one block. Rows of a run that is compared without blocks.
CROWD, COMPARED, SHORT = 1 << 20, 1 << 16, 32


def band_masks(threshold: int, agree: int = 1) -> list[int]:
    """Bit masks one of which two codes within the threshold must share.

    With ``threshold + agree`` bands at least ``agree`` bands are untouched by
    ``threshold`` changed bits, so every combination of ``agree`` bands is a
    mask. Bits are dealt to the bands in turn, as the leading bits of
    perceptual codes carry little information.
    """
    n = threshold + agree
    bands = [sum(1 << i for i in range(b, 64, n)) for b in range(n)]
    masks = [sum(c) for c in combinations(bands, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def bands_to_agree(codes: int, threshold: int) -> int:
    """How many bands a key joins so that an evenly spread set of codes leaves few of them to a key: keys grow with the logarithm of the set.

    At a distance of 4: two of six bands (15 keys of 21 bits) up to 2**23 codes,
    then three of seven (35 keys of 27 bits) and four of eight (70 of 32 bits).
    Wide thresholds have short bands and stay with single ones.
    """
    agree = 2 if threshold <= 8 else 1
    while threshold <= 8 and agree < 4 and codes > 1 << (64 * agree // (threshold + agree) + 2):
        agree += 1
    return agree


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def _masked(code: Column, masks: list[int], m: Column) -> Column:
    return code.bitwiseAND(F.get(F.array(*[F.lit(x) for x in masks]), m))


def _each_mask(masks: list[int]) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1)))


def _first_mask(diff: Column, masks: list[int]) -> Column:
    """The number of the first mask on which two codes agree."""
    first = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(i)).otherwise(first)
    return first


def code_pairs(left: DataFrame, right: DataFrame, threshold: int, same_side: bool = False, agree: int | None = None) -> DataFrame:
    """Pairs (a, b, dist) of the distinct codes of two one-column frames ``code`` within the threshold.

    Exact for every threshold below 64. Each pair comes once: a key emits it
    only if no earlier mask agrees too. With same_side, both frames are the
    same set and a < b holds. A row that moves is a code and the number of a
    mask; the planner takes it for no larger than the codes alone, so the hint
    keeps it from broadcasting what is many times their size.
    """
    masks = band_masks(threshold, agree or bands_to_agree(0, threshold))
    pick = lambda df, name: df.select(F.col("code").alias(name), _each_mask(masks).alias(f"m_{name}"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    on = (F.col("m_a") == F.col("m_b")) & (_masked(F.col("a"), masks, F.col("m_a")) == _masked(F.col("b"), masks, F.col("m_b")))
    joined = pick(left, "a").hint("merge").join(pick(right, "b"), on)
    if same_side:
        joined = joined.where(F.col("a") < F.col("b"))
    return joined.where((F.bit_count(diff) <= threshold) & (_first_mask(diff, masks) == F.col("m_a"))).select("a", "b", distance(F.col("a"), F.col("b")).alias("dist"))


def code_classes(df: DataFrame, id_col: str, codes: list[str]) -> DataFrame:
    """rep, n, codes...: rows with equal codes are one class, named after its least id; rows that lack a code are left out."""
    rows = df.where(F.col(id_col).isNotNull()).dropna(subset=codes)
    return rows.groupBy(*codes).agg(F.min(id_col).alias("rep"), F.count("*").alias("n"))


def near_classes(classes: DataFrame, threshold: int, code: str = "ph", second: str | None = None) -> DataFrame:
    """A, b (representatives, a < b), n_a, n_b, dist of the classes within the threshold by one code or by both.

    Classes instead of rows: copies of a code cost one comparison, and pairs of
    copies are not expanded. Only codes move until the pairs are found; names
    and counts are joined to these, which are not broadcast, as the planner
    can't know how many there are. With a second code, dist is the greater
    distance. The number of distinct codes decides on the length of the keys.
    """
    if second is not None:
        found = dual_pairs(classes, threshold, code, second)
    else:
        codes = cut(classes.select(F.col(code).alias("code")).distinct())
        found = code_pairs(codes, codes, threshold, same_side=True, agree=bands_to_agree(codes.count(), threshold)).select(F.col("a").alias("a1"), F.col("b").alias("b1"))
    keys = {"1": code} if second is None else {"1": code, "2": second}
    for x in "ab":
        side = classes.select(*[F.col(c).alias(f"{x}{i}") for i, c in keys.items()], F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"))
        found = found.hint("merge").join(side, [f"{x}{i}" for i in keys])
    dist = F.greatest(*[distance(F.col(f"a{i}"), F.col(f"b{i}")) for i in keys]) if second else distance(F.col("a1"), F.col("b1"))
    turned = F.col("rep_a") > F.col("rep_b")
    n = lambda x, y: F.when(turned, F.col(f"n_{y}")).otherwise(F.col(f"n_{x}")).alias(f"n_{x}")
    return found.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), n("a", "b"), n("b", "a"), dist.alias("dist"))


def compared(one: np.ndarray, two: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j in one run, within the threshold in both codes; short runs are compared together, long ones in blocks."""
    out_i, out_j, n = [], [], ends - starts

    def near(i: np.ndarray, j: np.ndarray, codes: tuple[np.ndarray, ...]) -> None:
        for c in codes:
            keep = np.bitwise_count(c[i] ^ c[j]) <= threshold
            i, j = i[keep], j[keep]
        out_i.append(i)
        out_j.append(j)

    few = (n > 1) & (n <= SHORT)
    last = np.repeat(ends[few], n[few])
    i = np.arange(len(last)) + np.repeat(starts[few] - np.cumsum(n[few]) + n[few], n[few])
    for d in range(1, SHORT):
        keep = i + d < last
        i, last = i[keep], last[keep]
        if not len(i):
            break
        near(i, i + d, (two, one))
    block = np.empty(max([COMPARED, *n[n > SHORT]]), np.uint64)
    for s, e in zip(starts[n > SHORT].tolist(), ends[n > SHORT].tolist(), strict=True):
        while e - s > 1:
            step = max(1, min(e - s, COMPARED // (e - s)))
            diff = np.bitwise_xor(two[s : s + step, None], two[None, s:e], out=block[: step * (e - s)].reshape(step, e - s))
            hit = np.flatnonzero(np.bitwise_count(diff).ravel() <= threshold)
            i, j = np.divmod(hit[hit // (e - s) < hit % (e - s)], e - s)
            if len(i):
                near(i + s, j + s, (one,))
            s += step
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none)


def runs(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal keys in a sorted order."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(new)
    return starts, np.r_[starts[1:], len(order)]


def cheapest_agree(n: float, threshold: int) -> int:
    """How many bands of the second code should agree among n rows that share one of the first: 0 to 3, by the estimated time of sorts, runs and comparisons (microseconds)."""
    cost = {0: n * n * 6e-4}
    for agree in (1, 2, 3):
        keys, buckets = comb(threshold + agree, agree), min(n, 2.0 ** (64 * agree / (threshold + agree)))
        cost[agree] = keys * (n * 0.15 + (buckets * 20 if n > SHORT * buckets else n * 0.1) + n * n / buckets * 6e-4)
    return min(cost, key=cost.get)


def near_in_task(c1: np.ndarray, c2: np.ndarray, m1: np.ndarray, m2: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i, j of the pairs of rows that meet by a band of the first code, m1, and if m2 is not negative by one of the second, within the threshold in both codes.

    A pair comes once, in either order: by the first bands on which it agrees.
    """
    masks, out_i, out_j = _u(band_masks(threshold)), [], []
    for crowd in (False, True):
        at = np.flatnonzero((m2 >= 0) == crowd)
        if not len(at):
            continue
        one, two, m = c1[at], c2[at], m1[at]
        k1 = one & masks[m]
        order = np.lexsort((k1, m))
        starts, ends = runs(order, k1, m)
        group = np.empty(len(at), np.int64)
        group[order] = np.repeat(np.arange(len(starts)), ends - starts)
        if crowd:
            seconds, agreed = [two & masks[m2[at]]], masks
        else:
            agree = cheapest_agree(((ends - starts) ** 2.0).sum() / len(at), threshold)
            agreed = _u(band_masks(threshold, agree)) if agree else np.zeros(1, np.uint64)
            seconds = (two & x for x in agreed)
        for number, k2 in enumerate(seconds):
            by = (k2, m2[at], group) if crowd else (k2, group)
            order = np.lexsort(by)
            i, j = compared(one[order], two[order], *runs(order, *by), threshold)
            i, j = order[i], order[j]
            first1, first2 = ((np.stack([((c[i] ^ c[j]) & x) == 0 for x in ms]).argmax(0)) for c, ms in ((one, masks), (two, agreed)))
            keep = (first1 == m[i]) & (first2 == (m2[at][i] if crowd else number))
            out_i.append(at[i[keep]])
            out_j.append(at[j[keep]])
    return np.concatenate(out_i or [np.zeros(0, np.int64)]), np.concatenate(out_j or [np.zeros(0, np.int64)])


def dual_pairs(classes: DataFrame, threshold: int, code: str, second: str, crowd: int = CROWD) -> DataFrame:
    """a1, a2, b1, b2: pairs of classes within the threshold in both codes, each once.

    Classes meet in tasks by one band of the first code. There they are divided
    by bands of the second where that saves time, and compared in numpy at about
    1 ns a comparison. Where more than ``crowd`` classes share a band of the
    first code, they are dealt by bands of the second as well, so that a task
    holds a bounded part of them.
    """
    masks = band_masks(threshold)
    rows = cut(classes.select(F.col(code).alias("c1"), F.col(second).alias("c2")))
    n = rows.count()
    keyed = rows.select("c1", "c2", _each_mask(masks).alias("m1")).withColumn("m2", F.lit(-1))
    key = lambda c, m: _masked(F.col(c), masks, F.greatest(F.col(m), F.lit(0)))
    if n > crowd:
        full = cut(keyed.groupBy("m1", key("c1", "m1").alias("k1")).agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select(F.col("m1").alias("m"), "k1"))
        on = (F.col("m1") == F.col("m")) & (key("c1", "m1") == F.col("k1"))
        keyed = keyed.join(full, on, "left_anti").unionByName(keyed.join(full, on, "left_semi").select("c1", "c2", "m1", _each_mask(masks).alias("m2")))
    tasks = int(max(2 * rows.sparkSession.sparkContext.defaultParallelism, n * len(masks) >> 19, n * n * len(masks) / 2 ** (64 / (threshold + 1)) / 2**31))
    dealt = keyed.repartition(tasks, "m1", key("c1", "m1"), "m2", F.when(F.col("m2") >= 0, key("c2", "m2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            c1, c2, m1, m2 = (t[c].to_numpy() for c in ("c1", "c2", "m1", "m2"))
            i, j = near_in_task(c1.view(np.uint64), c2.view(np.uint64), m1, m2, threshold)
            yield from pa.table({"a1": c1[i], "a2": c2[i], "b1": c1[j], "b2": c2[j]}).to_batches(max_chunksize=100_000)

    return dealt.mapInArrow(run, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")


def _u(masks: list[int]) -> np.ndarray:
    return np.array([m & (1 << 64) - 1 for m in masks], np.uint64)
