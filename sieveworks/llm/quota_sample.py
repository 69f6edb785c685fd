"""Problem 1: a sample whose category shares follow given targets.

Categories are counted, integer quotas are allotted by largest remainder with
minimum floors and availability caps, and each category gives the rows with the
smallest random keys. Categories that cannot be filled are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.functions.normal import latest_rows, word
from sieveworks.llm.selection import smallest_keys
from sieveworks.session import cut

CATEGORY = ["split", "pool", "question_type"]


def usable_items(records: DataFrame, bank: DataFrame) -> DataFrame:
    """item_id and the keys of its category.

    Latest row per item_id with a split, whose question is in the bank with a
    pool and a question type. Repeated bank rows of a question count once; a
    value missing in one of them is taken from another (the least if several).
    """
    latest = latest_rows(records, "item_id", "timestamp", ["item_id", "timestamp", "split", "question_id"])
    items = latest.select("item_id", "question_id", word("split").alias("split")).where(F.col("split").isNotNull())
    questions = bank.where(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.min(word("pool")).alias("pool"), F.min(word("question_type")).alias("question_type"))
    return items.join(questions.dropna(subset=["pool", "question_type"]), "question_id").select("item_id", *CATEGORY)


def quotas(items: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target category: available, wanted, quota and whether it can be filled.

    n (usable items of the split) counts items outside all targets too. wanted
    is the greater of min_items and n * sample_permille * share_permille /
    1,000,000, rounded down. quota: floors of min(wanted, available) first;
    what the rounding left of the split's sample goes to the largest
    remainders among categories with items to spare (ties by name), one each.
    Repeated target rows of a category count once; a target with a null number
    is read as 0.
    """
    t = targets.select(*[word(c).alias(c) for c in CATEGORY], *[F.col(c).alias(f"as_{c}") for c in CATEGORY], *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("sample_permille", "share_permille", "min_items")])
    t = t.groupBy(*CATEGORY).agg(*[F.min(c).alias(c) for c in (*[f"as_{c}" for c in CATEGORY], "sample_permille", "share_permille", "min_items")])
    counts = items.groupBy(*CATEGORY).agg(F.count("*").alias("available"))
    sizes = counts.groupBy("split").agg(F.sum("available").alias("n"))
    q = t.join(counts, CATEGORY, "left").join(sizes, "split", "left").fillna(0, ["available", "n"])
    exact = F.col("n") * F.col("sample_permille") * F.col("share_permille")
    q = q.withColumn("wanted", F.greatest("min_items", F.floor(exact / 1_000_000).cast("long"))).withColumn("remainder", F.when(F.col("min_items") > F.floor(exact / 1_000_000), F.lit(0)).otherwise(exact % 1_000_000))
    q = q.withColumn("base", F.least("wanted", "available"))
    by_split = W.partitionBy("split")
    spare = F.col("available") > F.col("base")
    q = q.withColumn("_left", F.greatest(F.lit(0), F.floor(F.col("n") * F.max("sample_permille").over(by_split) / 1000) - F.sum("base").over(by_split)))
    q = q.withColumn("_r", F.row_number().over(W.partitionBy("split").orderBy(spare.desc(), F.desc("remainder"), "pool", "question_type")))
    q = q.withColumn("quota", F.col("base") + F.when(spare & (F.col("remainder") > 0) & (F.col("_r") <= F.col("_left")), 1).otherwise(0))
    return q.select(*CATEGORY, *[f"as_{c}" for c in CATEGORY], "n", "available", "wanted", "quota", (F.col("available") < F.col("wanted")).alias("short"))


def shortfalls(records: DataFrame, bank: DataFrame, targets: DataFrame) -> DataFrame:
    """Target categories with fewer usable items than wanted, spelled as in the targets."""
    q = quotas(usable_items(records, bank), targets).where("short")
    return q.select(*[F.col(f"as_{c}").alias(c) for c in CATEGORY])


def sample(records: DataFrame, bank: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """item_id and category of the drawn items; categories with the smallest random keys first.

    The quota table has one row per target row (a closed list that does not
    grow with the data) and is broadcast, so that joining it needs no shuffle of
    the items. Items are written once and read for counts and for the draw.
    """
    items = cut(usable_items(records, bank))
    q = quotas(items, targets).select(*CATEGORY, *[f"as_{c}" for c in CATEGORY], "quota")
    rows = items.join(F.broadcast(q), CATEGORY).withColumn("_cat", F.concat_ws("|", *CATEGORY))
    drawn = smallest_keys(rows, "_cat", "item_id", "quota", seed)
    return drawn.select("item_id", *[F.col(f"as_{c}").alias(c) for c in CATEGORY])
