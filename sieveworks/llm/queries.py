"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.normal import latest_rows, path, usable_margin, word
from sieveworks.llm import cutoffs, group_split, match_groups, packing, quantile_digest, quota_sample, split_overlap, tokens, truncation
from sieveworks.session import cut, table

CAPACITY = 2048
MAX_HAMMING = 4
PERCENTILES = [0.5, 0.9, 0.95, 0.99]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.shortfalls(table(spark, d, "records"), table(spark, d, "question_bank"), table(spark, d, "sample_targets"))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.sample(table(spark, d, "records"), table(spark, d, "question_bank"), table(spark, d, "sample_targets"))


def _margins(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    rows = latest_rows(table(spark, d, "records"), "item_id", "timestamp", ["item_id", "timestamp", "margin", *keep])
    return rows.where(usable_margin("margin"))


def _day_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = _margins(spark, d, ["model", "severity"]).select(word("model").alias("model"), "severity", F.to_date("timestamp").alias("day"), "margin")
    return quantile_digest.digests(rows, "margin", ["model", "severity", "day"])


def p2_day_digests(spark: SparkSession, d: str) -> DataFrame:
    """The partial results per day that are kept and combined."""
    return _day_digests(spark, d)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    merged = quantile_digest.merge(_day_digests(spark, d), ["model", "severity"])
    return quantile_digest.percentiles(merged, ["model", "severity"], PERCENTILES)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return group_split.split_records(table(spark, d, "records"), table(spark, d, "question_bank"), table(spark, d, "split_proportions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return group_split.divided(_placed(spark, d))


def p3_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("group_id", "component", "n", "split")


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """How far the assignment is from the wanted proportions, per split and pool."""
    return group_split.balance(table(spark, d, "records"), table(spark, d, "question_bank"), table(spark, d, "split_proportions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "near_pairs").where(F.col("hamming").between(0, MAX_HAMMING)).select(path("a").alias("a"), path("b").alias("b"))
    return match_groups.linked_groups(pairs).select(F.col("group_id").alias("group_path"), F.col("record").alias("rel_path"))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    source = lambda: F.concat_ws("|", word("model"), word("condition")).alias("source")
    rows = _margins(spark, d, ["model", "condition"]).where(word("model").isNotNull() & word("condition").isNotNull())
    rows = cutoffs.settle(rows.select("item_id", source(), F.col("margin").alias("score")))
    targets = table(spark, d, "keep_targets").select(source(), "keep_permille", "model", "condition")
    return rows, targets


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows, targets = _scored(spark, d)
    return cutoffs.kept_rows(rows, cutoffs.edges(rows, targets)).select("item_id")


def p6_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    rows, targets = _scored(spark, d)
    return cutoffs.cutoffs(rows, targets).join(targets.select("source", "model", "condition"), "source").select("model", "condition", "keep_permille", "n", "cutoff", "kept")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    files = split_overlap.file_splits(table(spark, d, "inventory"), table(spark, d, "records"))
    return split_overlap.overlaps(files).select("a", "b")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    files = cut(split_overlap.file_splits(table(spark, d, "inventory"), table(spark, d, "records")))
    return split_overlap.report(files, split_overlap.overlaps(files))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and whether the ids decode to the very text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", (tokens.text_of(tokens.token_ids(F.col("text"))) == F.col("text").cast("binary")).alias("same"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sized = docs.select("doc_id", tokens.token_count(F.col("text")).alias("tokens"))
    return packing.pack(sized, "doc_id", F.col("tokens"), CAPACITY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(_packed(spark, d)).select(F.col("id").alias("doc_id"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select(F.col("id").alias("doc_id"), "piece", "pieces", F.col("size").alias("tokens"), "bin")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled: containers, items, tokens, and the share of all their space that is used."""
    fill = packing.bin_fill(_packed(spark, d)).agg(F.count("*").alias("bins"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"))
    return fill.withColumn("fill", F.try_divide(F.col("tokens"), F.col("bins") * CAPACITY))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).where("cut").select("doc_id")


def p10_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(truncation.truncated(table(spark, d, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_sample, p2_percentiles, p2_day_digests, p3_found, p3_assignment, p3_balance, p4_found, p6_found, p6_cutoffs, p7_found, p7_report, p8_ids, p8_round_trip, p9_found, p9_packed, p9_fill, p10_found, p10_by_source)}
