"""Min-hash bands of word shingles, and the exact similarity that candidates are held against."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words per shingle, and the similarity from which two texts are near copies.
WORDS = 5
SIMILARITY = 0.8
#: Bands and rows per band: a pair at 0.8 shares a band with probability 0.998.
BANDS = 16
ROWS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, each computed once; emptied when it has grown to a bound."""

    def __init__(self, bound: int = 500_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _runs(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of every run of ``words`` neighbours."""
    n = max(0, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for j in range(words):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingles(text: str, words: int = WORDS, known: Hashes | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``words`` lower-cased words; a shorter text is one shingle."""
    toks = text.lower().split()
    h = (Hashes() if known is None else known).of(toks)
    return np.unique(_runs(h, min(words, max(1, len(toks)))))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240611)
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


_A, _B = _coefficients(BANDS * ROWS)


def band_keys(texts: list[str], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the texts of a shingle or more, and their band keys, one row of BANDS each.

    A text of fewer words than a shingle has no near copy but itself and gets no
    key. All texts of the batch go through one array; a minimum does not mind
    repeated shingles. The number of a band is mixed into its keys.
    """
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    at = np.flatnonzero(sizes >= WORDS)
    if not len(at):
        return at, np.empty((0, BANDS), np.int64)
    h = known.of([w for i in at for w in split[i]])
    runs, n = _runs(h, WORDS), sizes[at]
    ends = np.cumsum(n)
    inside = np.ones(len(h), bool)
    for j in range(1, WORDS):
        inside[ends - j] = False
    x = (runs[inside[: len(runs)]] >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(n - WORDS + 1)[:-1]])
    keys = np.empty((len(at), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(at), band, np.uint64) * _MIX
        for r in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat(x * _A[r] + _B[r], starts)) * _MIX
            key ^= key >> np.uint64(31)
        keys[:, band] = key
    return at, keys.view(np.int64)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)
