"""Problem 10: texts whose end is missing because a field limit or a broken transfer cut them.

Two kinds of evidence are put together.

* Near-copies: distinct texts that share a min-hash band are candidates if one
  holds the other's last words and goes on there, which a sub-key of the bucket
  tells (`candidates`). Every candidate pair, in either order and of any
  doc_types, is verified (Jaccard over five-word shingles of 0.8 or more) and
  aligned. A text whose alignment ends early, in the middle of a sentence or
  line of the copy, was cut.
* Closing-word terminality, for texts that no alignment settles: how often the
  closing words of a text end a line or a text in all texts of its doc_type,
  against how often they stand inside one. In a doc_type with a usual layout
  (most of its texts close with one of a few forms) a text that closes otherwise
  was cut; where the usual form is a closing tag, the words before it count.

Closing words, lines and forms are counted over all distinct texts, so that
repeated copies of a cut text do not make its end look usual; shares of stock
remarks and the places of words inside texts count all documents. Each text is brought to one spelling and read twice, in Arrow batches:
once for its end, once for bands and for the places of words that matter. Only
numbers are shuffled; texts travel only where they are candidates.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import minhash
from sieveworks.session import saved

#: Marks that a writer leaves where it stopped.
MARK = re.compile(r"(?:\[cut\]|\(truncated\)|\[\+\d{1,40} chars\]|\w(?:…|\.\.\.))$")
#: Letters of other scripts that stand for Latin ones, and the Latin ones.
LOOK_ALIKE = str.maketrans("аеорсхуі", "aeopcxyi")
#: A closing form is usual in a doc_type from this share of its texts on; usual forms that cover USUAL_COVER make its layout.
USUAL_FORM, USUAL_COVER = 0.05, 0.8
#: A whole closing line is a sign-off from this share of its doc_type on: after a blank line, a comma or as a dashed line, and elsewhere.
SIGN_OFF, OTHER_LINE = 0.003, 0.01
#: In a doc_type in which this share of the documents is one line of fewer words than a shingle has, such a line is a remark.
#: It is whole from a share SIGN_OFF of the documents on, so that below 1 / SIGN_OFF documents one is enough; if characters
#: of unspaced scripts, counted as words, make it longer, from OTHER_LINE and two on.
BRIEF_SHARE = 0.25
#: A character of a script that is written without blanks (Thai to Khmer, kana, Han).
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005\u3007\u3021-\u3029\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f])")
SALT = 16
#: Marks that close a sentence.
STOPS = tuple(".!?。！？")
SENTENCE = re.compile(r"[.!?。！？][\"'”’»)\]]{0,40}$")
#: The closing form of all texts that end like a sentence. A doc_type where it is usual is free text and has no layout.
STOP = 1
#: Bits of the filters that tell which closing words matter: 1 MiB each, whatever the number of words. More words only let more through.
FILTER_BITS = 23
#: Characters that one slice of a batch holds, up to one text.
SLICE = 1 << 19
BRIEF, FEW, MARKED, BROKEN, ENDS, NUMBER, APART, TAGGED = (1 << i for i in range(8))

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LINE_ENDS = re.compile("\r\n?|[\v\f\u0085\u2028\u2029]")
_BLANK = "\t\u00a0\u1680\u180e\u2000-\u200a\u202f\u205f\u3000"
_BLANKS = re.compile(f"[ {_BLANK}]+")
_PLAIN_ODD = re.compile("[\r\v\f\t]|  ")
_ODD = re.compile(f"[\u00ad\u200b-\u200f\u2060\ufeff\ufb01\ufb02\r\v\f\u0085\u2028\u2029{_BLANK}]|  ")
_DIGITS = re.compile("[0-9][0-9a-f]*")
_TAG = re.compile(r"</?\w+ ?/?>")
_CLOSERS = re.compile(r"(?:\s*(?:</\w+>|<\w+ ?/>))+$")
_WORDS = re.compile("[ \n]+")
_LAST_FOUR = re.compile("[^ \n]+(?:[ \n]+[^ \n]+){3}$")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def canonical(text: str | None) -> str:
    """Text with one spelling of blanks and line ends, without invisible characters and outer blanks; empty for null."""
    if not text:
        return ""
    plain = text.isascii()
    if (_PLAIN_ODD if plain else _ODD).search(text):
        if not plain:
            text = _INVISIBLE.sub("", text).replace("\ufb01", "fi").replace("\ufb02", "fl")
        text = _BLANKS.sub(" ", _LINE_ENDS.sub("\n", text))
    if "\n" in text:
        text = text.replace(" \n", "\n").replace("\n ", "\n")
    return text.strip(" \n")


def numbered(text: str) -> str:
    """Text with every run of hexadecimal digits that holds a number as ``#``."""
    out, last = [], 0
    for m in _DIGITS.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in "abcdef":
            start -= 1
        out.append(text[last:start])
        last = m.end()
    return "#".join([*out, text[last:]]) if out else text


def name(canon: str) -> tuple[int, int]:
    """Two 64-bit hashes that stand for a text."""
    d = xxhash.xxh3_128_digest(canon)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(*words: str) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(words)) - (1 << 63)


def last_words(canon: str) -> list[str]:
    """The last four words, or fewer."""
    return canon.rsplit(None, 4)[-4:]


def tail_key(canon: str) -> int:
    return _signed(*last_words(canon))


def word_keys(kind: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a pair of words and of the second one alone in a doc_type, from their hashes."""
    w = (word ^ kind) * _MIX
    w ^= w >> np.uint64(32)
    p = ((before * _MIX) ^ w) * _MIX
    p ^= p >> np.uint64(32)
    return p.view(np.int64), w.view(np.int64)


def _bare(text: str) -> str:
    """Text without pictures and blanks behind its last word."""
    end = len(text)
    while end and (text[end - 1] in " \ufe0f\u200d" or unicodedata.category(text[end - 1]) in ("So", "Sk")):
        end -= 1
    return text[:end]


def closing(canon: str) -> tuple[str, str, str, str, int]:
    """What the end of a text looks like: its last line, the last two words, the closing form, and flags."""
    tag = _CLOSERS.search(canon) if canon[-1] == ">" else None
    inner = canon[: tag.start()] if tag else canon
    if "<" in inner:
        inner = _TAG.sub("\n", inner)
    tail = inner[inner.rfind("\n", 0, max(0, inner.rfind("\n"))) + 1 :]
    bare = _bare(numbered(tail if tail.isascii() else tail.translate(LOOK_ALIKE)))
    lines = bare.split("\n")
    line, above = lines[-1], lines[-2] if len(lines) > 1 else None
    words = line.strip(" ").split(" ")
    flags = (BRIEF | (FEW if len(UNSPACED.sub(r" \1 ", line).split()) < minhash.WORDS else 0)) if above is None and len(words) < minhash.WORDS else 0
    if MARK.search(canon, max(0, len(canon) - 64)):
        flags |= MARKED
    if bare.endswith("�"):
        flags |= BROKEN
    if SENTENCE.search(bare, max(0, len(bare) - 64)):
        flags |= ENDS
    if bare.endswith("#."):
        flags |= NUMBER
    if above == "" or (above is not None and above.endswith(",")) or line.startswith("--"):
        flags |= APART
    if tag:
        flags |= TAGGED
    return line, words[-2] if len(words) > 1 else "", words[-1], tag.group().strip() if tag else words[-1], flags


def _slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of SLICE characters at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.frombuffer(batch.column(column).buffers()[1], np.int32 if pa.types.is_string(batch.schema.field(column).type) else np.int64)[batch.column(column).offset :][: batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + SLICE, "right")) - 1)
            yield batch.slice(start, min(stop, batch.num_rows) - start)
            start = stop


def closings(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, kind (doc_type, empty if null), raw (hash of the text as it stands) and,
    null for null, empty and blank texts, h and g (hashes of the text in one spelling), line, pw, kw, form (hashes) and flags of its end."""
    types = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            kinds = b.column("kind").to_pylist()
            canons = [canonical(t) for t in b.column("text").to_pylist()]
            at = [i for i, c in enumerate(canons) if c]
            seen = [closing(canons[i]) for i in at]
            hash_of = lambda words: np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(at))
            kind = hash_of([kinds[i] for i in at])
            pw, kw = word_keys(kind, hash_of([s[1] for s in seen]), hash_of([s[2] for s in seen]))
            form = np.where([bool(s[4] & ENDS) and not s[4] & TAGGED for s in seen], STOP, hash_of([s[3] for s in seen]).view(np.int64)) if at else np.empty(0, np.int64)
            names = np.array([name(canons[i]) for i in at], np.int64).reshape(-1, 2)
            found = {"h": names[:, 0], "g": names[:, 1], "line": hash_of([s[0] for s in seen]).view(np.int64), "pw": pw, "kw": kw, "form": form, "flags": np.array([s[4] for s in seen], np.int64)}
            where = np.zeros(len(canons), np.int64)
            where[at] = np.arange(len(at))
            blank = np.ones(len(canons), bool)
            blank[at] = False
            spread = {k: pa.array(v[where] if len(at) else np.zeros(len(canons), np.int64), pa.int64(), mask=blank) for k, v in found.items()}
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("doc_id", "source", "kind", "raw")} | spread)

    rows = documents.select("doc_id", "source", F.coalesce("doc_type", F.lit("")).alias("kind"), "text", F.xxhash64("text").alias("raw"))
    out = f"doc_id {types['doc_id']}, source {types['source']}, kind string, raw bigint, h bigint, g bigint, line bigint, pw bigint, kw bigint, form bigint, flags bigint"
    return saved(rows.mapInArrow(run, out), "closings")


def distinct_texts(ends: DataFrame) -> DataFrame:
    """kind, h, g, raw (of one copy), copies and the end of every distinct text that is not blank."""
    return ends.where("h is not null").groupBy("kind", "h", "g", "line", "pw", "kw", "form", "flags").agg(F.count("*").alias("copies"), F.min("raw").alias("raw"))


def _has(flag: int):
    return F.col("flags").bitwiseAND(F.lit(flag)) != 0


def first_verdicts(texts: DataFrame) -> DataFrame:
    """kind, h, g, raw, pw, kw, number, often and verdict: cut, whole, or null where the places of the closing words have to tell.

    Broadcast are one row per doc_type, and of each doc_type 1 / SIGN_OFF lines
    of either kind and 1 / SIGN_OFF pairs of words at most, whatever its size.
    """
    brief_copies = F.when(_has(BRIEF), F.col("copies")).otherwise(0)
    sizes = texts.groupBy("kind").agg(F.count("*").alias("texts"), F.sum("copies").alias("documents"), (F.sum(brief_copies) / F.sum("copies")).alias("brief_share"))
    usual = texts.groupBy("kind", "form").agg(F.count("*").alias("n")).join(F.broadcast(sizes), "kind").where((F.col("n") >= 2) & (F.col("n") >= USUAL_FORM * F.col("texts")))
    layout = usual.groupBy("kind").agg(F.sum("n").alias("covered"), F.collect_set("form").alias("usual"), F.first("texts").alias("_t"))
    layout = layout.where((F.col("covered") >= USUAL_COVER * F.col("_t")) & ~F.array_contains("usual", STOP)).select("kind", "usual")
    signs = texts.groupBy("kind", "line").agg(F.count("*").alias("line_n"), F.sum(brief_copies).alias("said")).join(F.broadcast(sizes), "kind")
    signs = signs.where(((F.col("line_n") >= 2) & (F.col("line_n") >= SIGN_OFF * F.col("texts"))) | ((F.col("said") > 0) & (F.col("said") >= SIGN_OFF * F.col("documents")))).select("kind", "line", "line_n", "said")
    often = texts.where(_has(NUMBER)).groupBy("kind", "pw").agg(F.count("*").alias("closes")).join(F.broadcast(sizes), "kind")
    often = often.where((F.col("closes") >= 2) & (F.col("closes") >= SIGN_OFF * F.col("texts"))).select("kind", "pw", F.lit(True).alias("often"))
    t = texts.join(F.broadcast(sizes), "kind").join(F.broadcast(layout), "kind", "left").join(F.broadcast(signs), ["kind", "line"], "left").join(F.broadcast(often), ["kind", "pw"], "left")
    share = F.when(F.col("line_n") >= 2, F.col("line_n") / F.col("texts")).otherwise(0.0)
    signed = (share >= OTHER_LINE) | (_has(APART) & (share >= SIGN_OFF))
    said = F.coalesce("said", F.lit(0))
    remark = F.when(_has(FEW), said >= SIGN_OFF * F.col("documents")).otherwise((said >= 2) & (said >= OTHER_LINE * F.col("documents")))
    usual_form = F.array_contains("usual", F.col("form"))
    often = F.coalesce("often", F.lit(False))
    verdict = (
        F.when(_has(MARKED) | _has(BROKEN), "cut")
        .when(F.col("usual").isNotNull() & ~usual_form, "cut")
        .when(F.col("usual").isNotNull() & ~_has(TAGGED), "whole")
        .when(_has(BRIEF) & (F.col("brief_share") >= BRIEF_SHARE) & remark, "whole")
        .when(_has(ENDS), F.when(~_has(NUMBER) | often, "whole"))
        .when(signed, "whole")
    )
    return t.select("kind", "h", "g", "raw", "pw", "kw", (_has(ENDS) & _has(NUMBER)).alias("number"), verdict.alias("verdict"))


def key_filter(verdicts: DataFrame, key: str) -> np.ndarray:
    """Which keys of the closing words of open texts there are, as an array of 2**FILTER_BITS truths; a fixed number of bitmaps comes to the driver."""
    x = F.col(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    maps = verdicts.where("verdict is null").groupBy(F.shiftright(x, 15).alias("n")).agg(F.bitmap_construct_agg(x.bitwiseAND(F.lit(32767)).cast("bigint")).alias("bits"))
    out = np.zeros(1 << FILTER_BITS, bool)
    for r in maps.collect():
        out[r["n"] << 15 : (r["n"] + 1) << 15] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return out


def places(canons: list[str], kinds: np.ndarray, known: minhash.Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of the pair, key of the word, and whether a line ends behind it, of every word of the texts but their own last ones."""
    flat: list[str] = []
    sizes = np.empty(len(canons), np.int64)
    for i, c in enumerate(canons):
        words = (_TAG.sub("\n", c) if "<" in c else c).replace("\n", " \n ").split(" ")
        flat += words
        sizes[i] = len(words)
    ids, of = known.of(flat), np.repeat(np.arange(len(canons)), sizes)
    keep = ids != 0
    ids, of = ids[keep], of[keep]
    is_break = ids == 1
    edge = of[1:] != of[:-1]
    starts = np.concatenate([[True], edge | is_break[:-1]])[: len(ids)]
    stops = np.concatenate([edge | is_break[1:], [True]])[-len(ids) :] if len(ids) else edge
    words = np.flatnonzero(~is_break)
    own = np.concatenate([of[words][1:] != of[words][:-1], [True]])[-len(words) :] if len(words) else np.empty(0, bool)
    at = words[~own]
    before = np.where(starts[at], np.uint64(_EMPTY), ids[at - 1])
    pw, kw = word_keys(kinds[of[at]], before, ids[at])
    return pw, kw, stops[at]


def counted(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, and how often a line ends and does not end behind each."""
    found, at = np.unique(keys, return_inverse=True)
    e = np.bincount(at, ends, len(found)).astype(np.int64)
    return found, e, np.bincount(at, minlength=len(found)) - e


_EMPTY = xxhash.xxh3_64_intdigest("")


class _Shapes(minhash.Hashes):
    """Hashes of words with numbers in one spelling; 0 for no word and 1 for a line end."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = 0 if word == "" else 1 if word == "\n" else xxhash.xxh3_64_intdigest(numbered(word)) or 2
        return h


#: Tags of the rows of ``facts``.
BAND, PAIR, WORD = 0, 1, 2


def facts(documents: DataFrame, pairs: np.ndarray, words: np.ndarray) -> DataFrame:
    """The second reading of the texts.

    Rows of tag BAND are min-hash bands: a is the key, b the key of the text's
    last words, c the text's h. Rows of tag PAIR and WORD are counts of a slice:
    how often a line ends (b) and goes on (c) behind the pair or word a, for
    those that the two filters let through.
    """
    sent = documents.sparkSession.sparkContext.broadcast((np.packbits(pairs), np.packbits(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {PAIR: np.unpackbits(sent.value[0]).view(bool), WORD: np.unpackbits(sent.value[1]).view(bool)}
        hashes, shapes = minhash.Hashes(), _Shapes()
        row = lambda tag, a, b, c: pa.RecordBatch.from_pydict({"tag": np.full(len(a), tag, np.int8), "a": a, "b": b, "c": c})
        for batch in _slices(batches):
            texts = [(k, c) for k, t in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True) if (c := canonical(t))]
            if not texts:
                continue
            canons = [c for _, c in texts]
            at, keys = minhash.band_keys(canons, hashes)
            many = lambda f: np.repeat(np.array([f(canons[i]) for i in at], np.int64), minhash.BANDS)
            yield row(BAND, keys.ravel(), many(tail_key), many(lambda c: name(c)[0]))
            kinds = np.fromiter((xxhash.xxh3_64_intdigest(k) for k, _ in texts), np.uint64, len(texts))
            *found, ends = places(canons, kinds, shapes)
            for tag, key in zip((PAIR, WORD), found, strict=True):
                hit = wanted[tag][key & (len(wanted[tag]) - 1)]
                yield row(tag, *counted(key[hit], ends[hit]))

    rows = documents.where("text is not null").select(F.coalesce("doc_type", F.lit("")).alias("kind"), "text")
    return saved(rows.mapInArrow(run, "tag tinyint, a bigint, b bigint, c bigint"), "facts")


def _salted(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which the rows of one key are dealt to SALT tasks; right has one row per key."""
    many = right.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    return left.withColumn("_s", F.pmod(F.xxhash64("h"), F.lit(SALT)).cast("int")).join(many, [*on, "_s"], "left").drop("_s")


def settled(verdicts: DataFrame, seen: DataFrame) -> DataFrame:
    """kind, h, g of the texts that were cut, the open ones judged by where their closing words stand."""
    sums = lambda tag, key, ends, inside: seen.where(F.col("tag") == tag).groupBy(F.col("a").alias(key)).agg(F.sum("b").alias(ends), F.sum("c").alias(inside))
    t = verdicts.where("verdict is null")
    t = _salted(_salted(t, sums(PAIR, "pw", "ends", "inside"), ["pw"]), sums(WORD, "kw", "w_ends", "w_inside"), ["kw"]).fillna(0, ["ends", "inside", "w_ends", "w_inside"])
    both, alone = F.col("ends") + F.col("inside"), F.col("w_ends") + F.col("w_inside")
    inner = F.when(both > 0, F.col("ends") >= 0.5 * both).otherwise((alone > 0) & (F.col("w_ends") >= 0.5 * alone))
    late = t.where(~F.when(F.col("number"), both > 0).otherwise(inner)).select("kind", "h", "g")
    return verdicts.where("verdict = 'cut'").select("kind", "h", "g").unionByName(late)


def end_keys(canon: str) -> list[int]:
    """Two keys of the last place: three words before it and how its word begins, and the same with the whole word; none below four words."""
    words = _WORDS.split(canon)
    return [_signed(*words[-4:-1], words[-1][0]), _signed(*words[-4:], "")] if len(words) >= 4 else []


def inner_keys(canon: str) -> list[int]:
    """The keys of all ends that this text goes on from: at a place before its last word, or within its last word."""
    words = _WORDS.split(canon)
    inner = {_signed(*words[i - 3 : i], words[i][0]) for i in range(3, len(words) - 1)}
    if len(words) >= 4:
        inner |= {_signed(*words[-4:-1], words[-1][:k], "") for k in range(1, len(words[-1]))}
    return list(inner)


def candidates(members: DataFrame, texts: DataFrame) -> DataFrame:
    """short, other: texts of one bucket of which the second holds the end of the first and goes on there.

    members: key, h. texts: h, canon. No pair that ``ends_early`` accepts is
    left out: the three words before the last stand in both texts alike, and the
    last is a beginning of the other's word.
    """

    @F.pandas_udf("array<bigint>")
    def ends_of(s: pd.Series) -> pd.Series:
        return s.map(end_keys)

    @F.pandas_udf("array<bigint>")
    def inner_of(s: pd.Series) -> pd.Series:
        return s.map(inner_keys)

    ends = saved(texts.select("h", F.explode(ends_of("canon")).alias("sub")), "ends")
    goes_on = saved(texts.select("h", F.explode(inner_of("canon")).alias("sub")).join(ends.select("sub").distinct(), "sub", "left_semi"), "goes_on")
    met = ends.join(goes_on.select("sub").distinct(), "sub", "left_semi")
    short = members.join(met, "h").select("key", "sub", F.col("h").alias("short"))
    other = members.join(goes_on, "h").select("key", "sub", F.col("h").alias("other"))
    return sub_key_pairs(short, other).where("short <> other").distinct()


def sub_key_pairs(short: DataFrame, other: DataFrame) -> DataFrame:
    """short, other of equal key and sub; the others of one sub-key are dealt to SALT tasks, so that no bucket lies in one. Only names are joined, no texts."""
    many = short.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    dealt = other.withColumn("_s", F.pmod(F.xxhash64("other"), F.lit(SALT)).cast("int"))
    return many.join(dealt, ["key", "sub", "_s"]).select("short", "other")


def ends_early(short: str, other: str) -> bool:
    """True if other is a near-copy that goes on where short ends, inside a sentence or line. Texts that end alike settle nothing."""
    m = _LAST_FOUR.search(short)
    if not m:
        return False
    tail, slack = m.group(), int(0.2 * len(short)) + 10
    if last_words(short) == last_words(other):
        return False
    at = other.rfind(tail, max(0, m.start() - slack), len(short) + slack)
    while at > 0 and other[at - 1] not in " \n":
        at = other.rfind(tail, max(0, m.start() - slack), at + len(tail) - 1)
    if at < 0:
        return False
    rest = other[at + len(tail) :]
    if not rest.strip() or rest[0] == "\n" or (short[-1] in STOPS and not rest[0].isalnum()):
        return False
    return minhash.jaccard(minhash.shingles(short), minhash.shingles(other)) >= minhash.SIMILARITY


def aligned(documents: DataFrame, texts: DataFrame, seen: DataFrame) -> DataFrame:
    """h of the texts with a verified near-copy, of any doc_type, that goes on in the middle of a sentence or line where they end.

    Buckets whose texts all end in the same four words hold no early end and
    are left; the texts of the others are fetched by their hash.
    """
    bands = seen.where(F.col("tag") == BAND).select(F.col("a").alias("key"), F.col("b").alias("tail"), F.col("c").alias("h"))
    split = saved(bands.groupBy("key").agg(F.min("tail").alias("lo"), F.max("tail").alias("hi")).where("lo <> hi").select("key"), "buckets")
    members = saved(bands.join(split, "key", "left_semi").select("key", "h").distinct(), "members")
    raws = saved(texts.join(members.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("raw").alias("raw")).select("raw").distinct(), "raws")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canons = [canonical(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": pa.array([name(c)[0] for c in canons], pa.int64()), "canon": pa.array(canons, pa.string())})

    fetched = documents.select("text", F.xxhash64("text").alias("raw")).join(raws, "raw", "left_semi").groupBy("raw").agg(F.first("text").alias("text")).select("text")
    canons = saved(fetched.mapInArrow(spell, "h bigint, canon string").dropDuplicates(["h"]), "texts")
    pairs = saved(candidates(members, canons), "candidates")

    @F.pandas_udf("boolean")
    def early(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([ends_early(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    side = lambda c: canons.select(F.col("h").alias(c), F.col("canon").alias(f"{c}_text"))
    found = pairs.join(side("short"), "short").join(side("other"), "other").where(early("short_text", "other_text"))
    return found.select(F.col("short").alias("h")).distinct()


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id, source, cut of every document; cut is false for null, empty and blank texts.

    Copies of a text get one verdict. A null doc_type is a type of its own.
    Closing marks (``[cut]`` and the like) and a broken last character count as
    cut whatever stands before them.
    """
    ends = closings(documents)
    texts = saved(distinct_texts(ends), "distinct")
    verdicts = saved(first_verdicts(texts), "verdicts")
    seen = facts(documents, key_filter(verdicts, "pw"), key_filter(verdicts, "kw"))
    matched = texts.join(aligned(documents, texts, seen), "h", "left_semi").select("kind", "h", "g")
    flagged = settled(verdicts, seen).unionByName(matched).distinct().withColumn("cut", F.lit(True))
    many = flagged.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    rows = ends.select("doc_id", "source", "kind", "h", "g", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("_s"))
    return rows.join(many, ["kind", "h", "g", "_s"], "left").select("doc_id", "source", F.coalesce("cut", F.lit(False)).alias("cut"))


def by_source(verdicts: DataFrame) -> DataFrame:
    """source (null kept), documents, truncated, share."""
    return verdicts.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("truncated"), F.avg(F.col("cut").cast("double")).alias("share"))
