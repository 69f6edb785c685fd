"""The pipeline as jobs that read and write one folder: inventory, groups, splits, bank.

    python -m sieveworks.jobs inventory --root IMAGES --manifests FOLDER
    python -m sieveworks.jobs groups --manifests FOLDER
    python -m sieveworks.jobs splits --manifests FOLDER
    python -m sieveworks.jobs bank --root IMAGES --manifests FOLDER

A table appears only when it is whole and its checks hold: it is written beside
its place and moved there. A job whose checks fail writes nothing and raises.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.scalars import git_revision, stem
from sieveworks.operators import bank, grouping, inventory, pools
from sieveworks.session import cut, remove_scratch
from sieveworks.sources import files, sinks

#: What a reviewer is asked, by the type of a template.
ASKED = {
    "A": "Is the stated answer right, and would one ask this?",
    "C1": "Is it right to reject what the question presumes?",
    "C2": "Is it right to reject the stated context?",
    "D": "Can this truly not be told from the image alone?",
}


def scan_job(spark: SparkSession, root: str, manifests: str) -> dict:
    """Inventory of a folder of images, and its summary."""
    inv = cut(files.inventory(spark, root))
    sinks.write_whole(inv, f"{manifests}/inventory.parquet")
    doc = sinks.summary(
        counts=inventory.counts(inv), dimensions=inventory.dimensions(inv), sizes=inventory.top_sizes(inv), masks=inventory.area_summary(inv), unpaired=inventory.unpaired(inv).groupBy("side").agg(F.count("*").alias("stems")),
        mismatched=inventory.mismatched(inv).agg(F.count("*").alias("stems")), copies=inventory.exact_copies(inv).agg(F.count("*").alias("digests")),
    )
    sinks.write_json({"root": root, "revision": git_revision(), **doc}, f"{manifests}/inventory_summary.json")
    return doc


def group_job(spark: SparkSession, manifests: str, threshold: int = grouping.THRESHOLD) -> dict:
    """Groups of exact and near copies of the inventory's hashed images."""
    groups = cut(grouping.group_map(files.load_table(spark, manifests, "inventory").where("readable"), threshold))
    sinks.write_whole(groups, f"{manifests}/group_map.parquet")
    doc = sinks.summary(profile=grouping.profile(groups), sizes=grouping.size_distribution(groups), classes=grouping.class_collapse(groups), largest=grouping.largest(groups))
    sinks.write_json({"threshold": threshold, **doc}, f"{manifests}/grouping_summary.json")
    return doc


def split_checks(rows: DataFrame) -> DataFrame:
    """V4 and two more: digests in several splits, and copies of the segmentation set that lie apart from their group."""
    shas = rows.where("sha256 <> ''").groupBy("sha256").agg(F.countDistinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("digests_split"))
    seg = F.col("dataset") == "kvasir-seg-images"
    twins = rows.groupBy("group").agg(F.collect_set(F.when(seg, F.col("split"))).alias("a"), F.collect_set(F.when(~seg, F.col("split"))).alias("b"))
    apart = twins.agg(F.count_if((F.size("a") > 0) & (F.size("b") > 0) & (F.size(F.array_union("a", "b")) > 1)).alias("twins_apart"))
    return pools.split_violations(rows).join(F.broadcast(shas)).join(F.broadcast(apart))


def split_job(spark: SparkSession, manifests: str) -> dict:
    """Pools, strata and splits of the groups; images of excluded classes and groups take no part."""
    inv = files.load_table(spark, manifests, "inventory")
    groups = files.load_table(spark, manifests, "group_map")
    shas = inv.groupBy("rel_path").agg(F.min("sha256").alias("sha256"))
    rows = cut(pools.row_pools(groups.withColumn("class_label", F.when(F.col("dataset") == "kvasir-seg-images", "polyps").otherwise(F.col("class_label")))))
    by_group = cut(pools.group_pools(rows))
    usable = cut(pools.usable(rows, by_group))
    strata = cut(pools.strata(usable, pools.mask_areas(inv)))
    placed = pools.stratified_split(strata, "group", "stratum").select("group", "stratum", "split")
    out = cut(usable.join(placed, "group", "left").join(shas, "rel_path").select("rel_path", "dataset", "class_label", "sha256", "group", "pool", "stratum", "split"))
    sinks.write_checked(out, f"{manifests}/splits.parquet", split_checks(out))
    doc = sinks.summary(groups=pools.split_counts(out), images=out.groupBy("split").agg(F.count("*").alias("images")), conflicts=by_group.where("pools > 1").groupBy("pool").agg(F.count("*").alias("groups"), F.sum("dropped").alias("dropped")), laundered=pools.laundered(rows, by_group))
    sinks.write_json(doc, f"{manifests}/splits_summary.json")
    return doc


def bank_checks(items: DataFrame) -> DataFrame:
    """V3 and one more: D items that expect anything but abstention."""
    more = items.agg(F.count_if((F.col("question_type") == "D") & (F.col("expected_behaviour") != bank.ABSTAIN)).alias("d_not_abstaining"))
    return bank.checks(items).join(F.broadcast(more))


def bank_job(spark: SparkSession, root: str, manifests: str) -> dict:
    """The question bank of the splits' canonical images, and its review sheet."""
    rows = files.load_table(spark, manifests, "splits")
    canon = pools.canonical_rows(rows).withColumn("stem", stem(F.col("rel_path")))
    canon = cut(canon.join(files.component_facts(spark, root), "stem", "left").drop("stem"))
    items = cut(bank.build_items(canon, bank.template_table(spark), bank.paraphrased_groups(canon)).withColumnRenamed("rel_path", "image_rel_path"))
    sinks.write_checked(items, f"{manifests}/question_bank.parquet", bank_checks(items))
    ask = F.lit(ASKED["A"])
    for kind, text in ASKED.items():
        ask = F.when(F.col("question_type") == kind, text).otherwise(ask)
    review = bank.review_table(items).withColumn("please_judge", ask).select("*", *[F.lit("").alias(c) for c in ("right", "realistic", "notes", "reviewer")])
    sinks.write_csv(review, f"{manifests}/question_bank_review.csv")
    sinks.write_text(sinks.markdown(review, "Templates to review"), f"{manifests}/question_bank_review.md")
    doc = sinks.summary(types=items.groupBy("question_type").agg(F.count("*").alias("items")), splits=items.groupBy("split").agg(F.count("*").alias("items")), balance=bank.answer_balance(items))
    sinks.write_json(doc, f"{manifests}/question_bank_summary.json")
    return doc


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sieveworks.jobs")
    p.add_argument("job", choices=["inventory", "groups", "splits", "bank"])
    p.add_argument("--root", help="folder of the images")
    p.add_argument("--manifests", required=True, help="folder of the tables")
    p.add_argument("--threshold", type=int, default=grouping.THRESHOLD, help="bits by which near copies differ at most")
    a = p.parse_args(argv)
    if a.job in ("inventory", "bank") and not a.root:
        p.error("--root is needed")
    spark = SparkSession.builder.appName(f"sieveworks-{a.job}").getOrCreate()
    try:
        {"inventory": lambda: scan_job(spark, a.root, a.manifests), "groups": lambda: group_job(spark, a.manifests, a.threshold), "splits": lambda: split_job(spark, a.manifests), "bank": lambda: bank_job(spark, a.root, a.manifests)}[a.job]()
    finally:
        remove_scratch(spark)


if __name__ == "__main__":
    main()
