"""Problem 8: token ids of whole texts by a public byte-level tokenizer, and back.

The rank file is a local path on every executor (a parameter). Texts longer
than CHUNK are split where white space follows another character: no token of
the pattern holds such a place inside, and no alternative of it looks back, so
that the ids of the parts, put together, are those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: where the tokenizer's vocabulary lies and the pattern its merges start from.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 20_000
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(rank_file: str = RANK_FILE):
    """The tokenizer of a rank file, once per worker process."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """Parts of a text whose ids, put together, are the ids of the text."""
    start = 0
    while len(text) - start > chunk:
        m = _SAFE.search(text, start + chunk)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, rank_file: str = RANK_FILE, chunk: int = CHUNK) -> list[int]:
    if not text:
        return []
    enc = encoding(rank_file)
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, chunk) for i in enc.encode_ordinary(part)]


def decode(ids: list[int] | None, rank_file: str = RANK_FILE) -> bytes:
    return encoding(rank_file).decode_bytes(list(ids)) if ids is not None and len(ids) else b""


def token_ids(text: Column, rank_file: str = RANK_FILE) -> Column:
    """Array of ids; empty for an empty and for a null text. Strings of special tokens are ordinary text."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([encode(t, rank_file) for t in s], dtype=object)

    return run(text)


def token_count(text: Column, rank_file: str = RANK_FILE) -> Column:
    """Number of tokens; 0 for an empty and for a null text."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([len(encode(t, rank_file)) for t in s], dtype="int32")

    return run(text)


def text_of(ids: Column, rank_file: str = RANK_FILE) -> Column:
    """The bytes that the ids stand for; empty for an empty and for a null list."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([decode(x, rank_file) for x in s], dtype=object)

    return run(ids)


def encoded(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """doc_id, ids of every document."""
    return documents.select("doc_id", token_ids(F.col("text"), rank_file).alias("ids"))
