"""Problem 7: files that occur on both sides of a split, exactly or nearly.

A perceptual code is the set of its 64 shingles (position, bit). Two codes that
differ in d bits share 64 - d of 64 + d shingles, so that a distance of 4 is a
Jaccard similarity of 60 / 68, the least that counts here.

Min-hash takes the shingle that a permutation ranks first. The permutations used
rank both shingles of one position first, then those of the next, so that a
band of min-hashes is the code's bits at the band's positions. Which positions
go into a band is not drawn at random: six blocks of positions, of which two
make a band, leave every pair of at most 4 differing bits a band that agrees.
Fifteen bands of 21 random permutations would keep 0.67 of such pairs (0.882 is
the chance that one min-hash agrees), these keep all. Only buckets that hold
both sides give candidates, and each is verified by its exact Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.normal import code64, hex_digest, path, word
from sieveworks.functions.scalars import stem
from sieveworks.operators.hamming import band_masks
from sieveworks.session import cut

BITS = 64
SALT = 16
TRAIN_SIDE = ["train", "esttrain"]
EVAL_SIDE = ["cal", "test"]


def file_splits(inventory: DataFrame, records: DataFrame) -> DataFrame:
    """rel_path, dataset, sha, code, split of the image files whose records carry a split, one row per distinct hash pair of a file.

    image_id is ``kvasir-seg/`` or ``hyperkvasir/`` and the stem of the file;
    masks are no images. Rows without a path are left out.
    """
    p = path("rel_path")
    image = F.concat(F.when(p.startswith("kvasir-seg/"), "kvasir-seg/").otherwise("hyperkvasir/"), stem(p))
    files = inventory.select(p.alias("rel_path"), F.col("dataset"), hex_digest("sha256").alias("sha"), code64("phash").alias("code"), image.alias("image_id"))
    files = files.where(F.col("rel_path").isNotNull() & ~F.col("rel_path").startswith("kvasir-seg/masks/") & ~F.coalesce(F.col("dataset").endswith("-masks"), F.lit(False)))
    splits = records.select(F.col("image_id"), word("split").alias("split")).where(F.col("split").isNotNull() & F.col("image_id").isNotNull()).groupBy("image_id").agg(F.min("split").alias("split"))
    return files.join(splits, "image_id").select("rel_path", "dataset", "sha", "code", "split").distinct()


def least_similarity(threshold: int) -> float:
    """Jaccard similarity of two codes that differ in ``threshold`` bits."""
    return (BITS - threshold) / (BITS + threshold)


def similarity(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of the shingles of two codes."""
    differing = F.bit_count(a.bitwiseXOR(b))
    return (BITS - differing) / (BITS + differing)


def band_keys(code: Column, threshold: int) -> Column:
    """An array of (band, key): the min-hashes of each band, which are the code's bits at its positions."""
    return F.array(*[F.struct(F.lit(i).alias("band"), code.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(band_masks(threshold, 2))])


def near_codes(train: DataFrame, evaluation: DataFrame, threshold: int) -> DataFrame:
    """a, b: distinct codes of the two sides (one column ``code`` each) that are similar; each pair comes from the first band it agrees in."""
    banded = lambda df, name: df.select(F.col("code").alias(name), F.explode(band_keys(F.col("code"), threshold)).alias("_k")).select(name, "_k.band", "_k.key")
    met = banded(train, "a").join(banded(evaluation, "b"), ["band", "key"])
    diff = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(band_masks(threshold, 2))])
    return met.where((similarity(F.col("a"), F.col("b")) >= least_similarity(threshold)) & (first == F.col("band"))).select("a", "b")


def _dealt(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join on a key whose left rows are dealt to SALT tasks, as each pair of them and the right ones is a result."""
    dealt = left.withColumn("_s", F.pmod(F.xxhash64("x"), F.lit(SALT)).cast("int"))
    return dealt.join(right.withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(SALT)]))), [key, "_s"]).select("x", "y")


def overlaps(files: DataFrame, threshold: int = 4) -> DataFrame:
    """a, b (the smaller path first), kind: pairs of one file of each side with equal sha or codes within the threshold.

    kind is ``exact`` if a sha agrees, else ``near``. A missing hash matches
    nothing; of a file with several rows any row's hash counts. Codes are
    compared as distinct values of a side, so that copies of one code cost one
    comparison; they are expanded at the end, as the result names pairs of files.
    A value that only one side has is dropped before that.
    """
    side = F.when(F.col("split").isin(TRAIN_SIDE), "t").when(F.col("split").isin(EVAL_SIDE), "e")
    f = cut(files.select("rel_path", "sha", "code", side.alias("side")).where("side is not null"))
    of = lambda s, key, name: f.where((F.col("side") == s) & F.col(key).isNotNull()).select(F.col("rel_path").alias(name), key).distinct()
    both = f.where("sha is not null").groupBy("sha").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo <> hi").select("sha")
    shared = lambda s, name: of(s, "sha", name).join(both, "sha", "left_semi")
    exact = _dealt(shared("t", "x"), shared("e", "y"), "sha").select("x", "y", F.lit(0).alias("k"))
    codes = lambda s: f.where((F.col("side") == s) & F.col("code").isNotNull()).select("code").distinct()
    similar = cut(near_codes(codes("t"), codes("e"), threshold))
    left = of("t", "code", "x").join(similar, F.col("code") == F.col("a")).select("x", "b")
    near = _dealt(left, of("e", "code", "y").withColumnRenamed("code", "b"), "b").select("x", "y", F.lit(1).alias("k"))
    found = exact.unionByName(near).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "k")
    return found.groupBy("a", "b").agg(F.min("k").alias("k")).select("a", "b", F.when(F.col("k") == 0, "exact").otherwise("near").alias("kind"))


def report(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overlapping files of the evaluation side per split, dataset and kind; files is file_splits, pairs is overlaps."""
    ends = pairs.select("kind", F.explode(F.array("a", "b")).alias("rel_path")).groupBy("rel_path").agg(F.min("kind").alias("kind"))
    info = files.select("rel_path", "dataset", "split").distinct()
    return info.join(ends, "rel_path", "left").groupBy("split", "dataset").agg(F.countDistinct("rel_path").alias("files"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "near").alias("near"))
