"""Scoring of closed answers from option log-probabilities, and the probe's checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.scalars import LETTERS, argmax_margin, build_prompt, hash_order, log_softmax, shuffled_options

#: Bounds of the probe: greatest score difference of a repeat, share of items whose answer flips, accuracy above chance.
DETERMINISM, FLIPS, ABOVE_CHANCE = 1e-4, 0.25, 0.10


def normalised(records: DataFrame) -> DataFrame:
    """item_id, timestamp, choice, margin and its probability from the stored log-probabilities, in the order of the options.

    Options without a score are left out; ties fall to the earlier option; the
    margin is infinite for one option. Records without any score give nulls.
    """
    options = F.filter(F.array_distinct("options"), lambda o: F.map_contains_key("option_logprobs", o))
    r = records.withColumn("_o", options).withColumn("_s", F.transform("_o", lambda o: F.col("option_logprobs")[o]))
    r = r.withColumn("_l", log_softmax(F.col("_s")))
    best, margin = argmax_margin(F.col("_l"))
    return r.select("item_id", "timestamp", F.get("_o", best).alias("choice"), F.round(margin, 6).alias("margin"), F.round(F.exp(F.get("_l", best)), 6).alias("probability"))


def letter_ids(encode: Callable[[str], list[int]], n: int) -> list[int]:
    """M3: the first token of each of the first n letters; raises if a letter has none or two letters share one."""
    ids = [(encode(c) or [None])[0] for c in LETTERS[:n]]
    if None in ids or len(set(ids)) < len(ids) or n > len(LETTERS):
        raise ValueError(f"letters can't be told apart by their first tokens: {ids}")
    return ids


def seeded_options(item: Column, options: Column) -> Column:
    """Options in the order of numpy's generator seeded with the first 8 hex digits of the item's sha256; null for null options.

    The order that answers scored elsewhere were shown in; ``shuffled_options``
    stays inside the JVM and is the one for everything new.
    """

    @F.pandas_udf("array<string>")
    def run(ids: pd.Series, opts: pd.Series) -> pd.Series:
        order = lambda i, n: np.random.default_rng(int(hashlib.sha256((i or "").encode()).hexdigest()[:8], 16)).permutation(n)
        return pd.Series([None if o is None else [o[k] for k in order(i, len(o))] for i, o in zip(ids, opts, strict=True)], dtype=object)

    return run(item, options)


def letter_scorer(stub: Callable[[str, list[str]], list[float]], continuation: Callable[[str, str], tuple[float, int]] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """M1: a mapInPandas function around a model.

    ``stub`` gives one log-probability per letter of a prompt; ``continuation``
    the total log-probability of a text behind a prompt and its number of tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = list(zip(pdf["prompt"], pdf["shown"], strict=True))
            full = [None if continuation is None else [total / max(1, n) for total, n in (continuation(p, f" {x}") for x in o)] for p, o in asked]
            yield pd.DataFrame({"question_id": pdf["question_id"], "shown": pdf["shown"], "scores": [stub(p, list(LETTERS[: len(o)])) for p, o in asked], "full": full})

    return run


def score_items(items: DataFrame, stub: Callable[[str, list[str]], list[float]], seed: int | str | None = 0, continuation: Callable[[str, str], tuple[float, int]] | None = None) -> DataFrame:
    """M2: question_id, shown (options as presented), logprobs (map), chosen, margin, and fulltext (map of length-normalised log-probabilities of the option texts; null without ``continuation``).

    Only the model runs in Python; shuffle, prompt, normalisation and choice
    are column expressions. Without a seed the order is that of
    ``seeded_options``. More than 8 options raise.
    """
    order = seeded_options(F.col("question_id"), F.col("options")) if seed is None else shuffled_options(F.col("question_id"), F.col("options"), seed)
    shown = items.select("question_id", order.alias("shown"), "question_text")
    n = F.size("shown")
    shown = shown.withColumn("shown", F.when(n <= len(LETTERS), F.col("shown")).otherwise(F.raise_error(F.lit("more than 8 options"))))
    asked = shown.select("question_id", "shown", build_prompt(F.col("question_text"), F.col("shown")).alias("prompt"))
    raw = asked.mapInPandas(letter_scorer(stub, continuation), "question_id string, shown array<string>, scores array<double>, full array<double>")
    r = raw.withColumn("lp", log_softmax(F.col("scores")))
    best, margin = argmax_margin(F.col("lp"))
    return r.select("question_id", "shown", F.map_from_arrays("shown", "lp").alias("logprobs"), F.get("shown", best).alias("chosen"), margin.alias("margin"), F.map_from_arrays("shown", "full").alias("fulltext"))


def reordered(items: DataFrame, stub: Callable[[str, list[str]], list[float]], salts: tuple[str, ...] = ("", "#1", "#2")) -> DataFrame:
    """question_id and chosen_option of every item under several orders of its options, one per salt."""
    many = items.select(F.col("question_id").alias("_id"), F.explode(F.array(*[F.lit(s) for s in salts])).alias("_salt"), "question_text", "options")
    scored = score_items(many.select(F.to_json(F.struct("_id", "_salt")).alias("question_id"), "question_text", "options"), stub)
    return scored.select(F.get_json_object("question_id", "$._id").alias("question_id"), F.col("chosen").alias("chosen_option"))


def probe_subset(items: DataFrame, n: int = 40, template: str = "presence", kind: str = "A", split: str = "train", seed: int = 0) -> DataFrame:
    """N questions (fewer if there are no more) of one template, type and split, the first in hash order.

    items: question_id, template_id, question_type, split; repeated questions count once.
    """
    easy = items.where((F.col("template_id") == template) & (F.col("question_type") == kind) & (F.col("split") == split)).select("question_id").distinct()
    return easy.orderBy(hash_order(seed, F.col("question_id")), "question_id").limit(n)


def flip_rate(answers: DataFrame, item: list[str], by: list[str]) -> DataFrame:
    """per ``by``, items and the share of items with more than one distinct answer; missing answers are left out."""
    per = answers.where(F.col("chosen_option").isNotNull()).groupBy(*by, *item).agg(F.min("chosen_option").alias("lo"), F.max("chosen_option").alias("hi"))
    return per.groupBy(*by).agg(F.count("*").alias("items"), F.round(F.avg((F.col("lo") != F.col("hi")).cast("double")), 6).alias("flip_rate"))


def score_delta(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, greatest absolute difference of two score maps over all options (a missing score counts as infinitely far), all finite, and whether scores differ at 6 digits."""
    j = left.select(key, F.col("scores").alias("a")).join(right.select(key, F.col("scores").alias("b")), key)
    diff = F.map_zip_with("a", "b", lambda k, x, y: F.when(x.isNull() | y.isNull(), F.lit(float("inf"))).otherwise(F.abs(x - y)))
    values = F.map_values("a")
    return j.select(key, F.round(F.array_max(F.map_values(diff)), 6).alias("delta"), F.forall(values, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"), (F.size(F.array_distinct(F.transform(values, lambda v: F.round(v, 6)))) > 1).alias("varied"))


def accuracy(records: DataFrame, abstain: str) -> DataFrame:
    """per model over answerable records: n, accuracy, abstentions, chance of each record's own options averaged, and whether the gate holds."""
    ok = records.where(F.col("answerable") & F.col("correct").isNotNull())
    g = ok.groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
        F.count_if(F.coalesce(F.col("chosen_option").contains(abstain), F.lit(False))).alias("abstained"), F.round(F.avg(1.0 / F.greatest(F.size("options"), F.lit(1))), 6).alias("chance"),
    )
    return g.withColumn("passed", F.col("accuracy") > F.col("chance") + ABOVE_CHANCE)


def chosen_counts(records: DataFrame) -> DataFrame:
    """how often each option was chosen, per model."""
    return records.groupBy("model", "chosen_option").agg(F.count("*").alias("records"))


def probe_gate(spark: SparkSession, delta: float | None, flips: float | None, accuracy_: float | None, chance: float | None) -> DataFrame:
    """V9: check, value, passed; a missing value fails."""
    rows = [
        ("determinism", delta, delta is not None and delta < DETERMINISM),
        ("flips", flips, flips is not None and flips <= FLIPS),
        ("accuracy", accuracy_, accuracy_ is not None and chance is not None and accuracy_ > chance + ABOVE_CHANCE),
    ]
    return spark.createDataFrame(rows, "check string, value double, passed boolean")


def gpu_hours(seconds_per_item: float, items: int = 18_000, passes: int = 20) -> float:
    """M5."""
    return items * passes * seconds_per_item / 3600

