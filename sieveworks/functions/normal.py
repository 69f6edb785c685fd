"""Spelling-free forms of the values that several writers spell in their own ways.

Every function takes a column (or its name) and gives a column; null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for "missing" once case, blanks and separators are gone.
MISSING_WORDS = ["", "none", "(none)", "nan", "null", "na", "n/a", "nil", "missing"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word(c: Column | str) -> Column:
    """A word of a closed vocabulary without case, blanks and separators; null if missing.

    ``Est-Train``, ``est train`` and ``EST_TRAIN `` all give ``esttrain``.
    """
    key = F.lower(F.regexp_replace(_col(c), r"[\s\p{Z}_\-]+", ""))
    return F.when(~key.isin(MISSING_WORDS), key)


def spelled(c: Column | str, vocabulary: list[str]) -> Column:
    """The plain spelling of a word of a small closed vocabulary; null if missing, the key if unknown."""
    key = word(c)
    out = key
    for v in vocabulary:
        out = F.when(key == _key(v), F.lit(v)).otherwise(out)
    return out


def _key(v: str) -> str:
    import re

    return re.sub(r"[\s_\-]+", "", v).lower()


def path(c: Column | str) -> Column:
    """A path with forward slashes, without leading ``./`` and outer blanks."""
    p = F.regexp_replace(F.regexp_replace(_col(c), r"\\", "/"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.regexp_replace(p, r"^(\./+)+", "")


def hex_digest(c: Column | str) -> Column:
    """A hexadecimal digest by its value: lower case, without blanks and ``0x``; null if empty."""
    h = F.regexp_replace(F.lower(F.regexp_replace(_col(c), r"[\s\p{Z}]+", "")), "^0x", "")
    return F.when(h.rlike("^[0-9a-f]+$"), h)


def code64(c: Column | str) -> Column:
    """A 64-bit hexadecimal code as the bigint with the same bits; null if malformed or all zero."""
    h = hex_digest(c)
    v = F.conv(F.when(F.length(h) <= 16, h), 16, -10).cast("bigint")
    return F.when(v != 0, v)


def hex_code(c: Column | str) -> Column:
    """16 hexadecimal digits as the bigint with the same bits, zero included."""
    return F.conv(_col(c), 16, -10).cast("bigint")


def group_number(c: Column | str) -> Column:
    """The number in a group label such as ``G-77``, ``grp_77 ``, ``0000000077`` or ``77.0``."""
    digits = F.regexp_extract(_col(c), r"(\d+)(?:\.0*)?[\s\p{Z}]*$", 1)
    return F.when(digits != "", digits.try_cast("decimal(38,0)").try_cast("bigint"))


def usable_margin(c: Column | str) -> Column:
    """True if a margin is present, finite and not negative (never null)."""
    m = _col(c)
    return F.coalesce(m.isNotNull() & ~F.isnan(m) & (m >= 0) & (m < F.lit(float("inf"))), F.lit(False))


def latest_rows(df: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` (null counts as earliest).

    Rows without a key are no items and are left out. Rows that tie are copies;
    the greatest of the kept values decides, so that the result is stable.
    """
    rest = [c for c in keep if c not in (key, order)]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in keep if c != key])
