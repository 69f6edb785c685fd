"""Problem 9: items of varying length in containers of fixed capacity.

Bounded-space online best fit: a task holds a fixed number of open bins. The
bins lie in a table by free space, and a bitset says which free spaces occur,
so that the tightest bin that still takes an item is the lowest set bit at or
above the item's size. If no bin takes the item, a new one is opened, and if
too many are open the fullest closes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins that a task holds open. At the end of a task they are closed as they are.
OPEN_BINS = 64


class Packer:
    """place(size) gives the number of the bin that the item goes to; 1 <= size <= capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits = 0
        self.held = self.made = 0

    def _put(self, b: int, free: int) -> None:
        self.free.setdefault(free, []).append(b)
        self.bits |= 1 << free
        self.held += 1

    def _take(self, free: int) -> int:
        at = self.free[free]
        b = at.pop()
        if not at:
            del self.free[free]
            self.bits &= ~(1 << free)
        self.held -= 1
        return b

    def place(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.held >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.capacity, self.made
            self.made += 1
        if free > size:
            self._put(b, free - size)
        return b


def pack(items: DataFrame, id_col: str, size: Column, capacity: int, open_bins: int = OPEN_BINS) -> DataFrame:
    """id, piece, pieces, size, bin: one row per piece of an item.

    An item that exceeds the capacity is split into full pieces and a rest; no
    other item is split. An item of size 0 (or null, or below 0) takes no space
    and gets one row with a null bin, so that none is lost. Every task packs
    its own rows, in their order, into bins of its own number range; repeated
    ids are items of their own.
    """
    kind = dict(items.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 32
        for pdf in batches:
            ids, piece, pieces, sizes, bins = [], [], [], [], []
            for i, n in zip(pdf["id"], pdf["size"], strict=True):
                parts = [capacity] * (n // capacity) + ([n % capacity] if n % capacity else []) if n > 0 else [0]
                for k, part in enumerate(parts):
                    ids.append(i)
                    piece.append(k)
                    pieces.append(len(parts))
                    sizes.append(part)
                    bins.append(base + packer.place(part) if part else None)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=pdf["id"].dtype), "piece": pd.Series(piece, dtype="int32"), "pieces": pd.Series(pieces, dtype="int32"), "size": pd.Series(sizes, dtype="int32"), "bin": pd.array(bins, dtype="Int64")})

    rows = items.select(F.col(id_col).alias("id"), F.coalesce(size, F.lit(0)).cast("int").alias("size"))
    return rows.mapInPandas(run, f"id {kind}, piece int, pieces int, size int, bin bigint")


def oversized(packed: DataFrame) -> DataFrame:
    """Ids of the items that had to be split."""
    return packed.where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("id")


def bin_fill(packed: DataFrame) -> DataFrame:
    """bin, used, items: how full each bin is."""
    return packed.where(F.col("bin").isNotNull()).groupBy("bin").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
