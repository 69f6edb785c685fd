"""Question banks with closed answers: building, sampling, integrity checks, review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.functions.scalars import count_bucket, hash_order, keyed_id, other_options, resolved_class, with_abstain
from sieveworks.operators.ranks import hash_rank
from sieveworks.session import saved

SEED = 4127
ABSTAIN = "cannot be determined from this image"
PARAPHRASE_FRACTION = 0.25
# Template, type, text, pools, options, answer rule, number of items wanted (null: all), mechanism.
TEMPLATES = [
    ("presence", "A", "Is there a polyp?", ["polyp", "colonic_negative"], ["yes", "no"], "pool", None, "answer"),
    ("count", "A", "How many polyps are there?", ["polyp", "colonic_negative"], ["0", "1", "2 or more"], "components", None, "answer"),
    ("location", "A", "Where is the polyp?", ["polyp"], ["centre", "upper left", "upper right", "lower left", "lower right"], "region", None, "answer"),
    ("finding_class", "A", "Which finding is it?", ["polyp", "colonic_negative", "colonic_pathology_nonpolyp"], ["polyp", "normal mucosa", "ulcerative colitis", "haemorrhoids"], "class", None, "answer"),
    ("polyp_morphology", "C1", "What shape is the polyp?", ["colonic_negative", "colonic_pathology_nonpolyp"], ["pedunculated", "sessile", "flat", "no polyp is visible"], "last", 500, "premise"),
    ("ulcer_bleeding", "C1", "Is the ulcer bleeding?", ["polyp", "colonic_negative"], ["yes", "no", "no ulcer is visible"], "last", 300, "premise"),
    ("wrong_organ", "C2", "Which part of the colon is it?", ["upper_gi"], ["caecum", "rectum", "sigmoid colon", "this is not a colonic image"], "last", 500, "premise"),
    ("wrong_procedure", "C2", "Did the dye spread?", ["polyp", "colonic_negative"], ["yes", "no", "no dye has been applied in this image"], "last", 300, "premise"),
    ("histology", "D", "What is the histology?", ["polyp", "colonic_pathology_nonpolyp"], ["tubular adenoma", "hyperplastic polyp", "adenocarcinoma", "chronic inflammation"], "abstain", 200, "evidence"),
    ("biopsy_malignancy", "D", "Was a biopsy malignant?", ["polyp"], ["yes", "no"], "abstain", 150, "evidence"),
    ("prior_colonoscopy", "D", "Was there an earlier colonoscopy?", ["polyp", "colonic_negative"], ["yes", "no"], "abstain", 150, "evidence"),
    ("patient_age", "D", "How old is the patient?", ["polyp", "colonic_negative", "colonic_pathology_nonpolyp"], ["under 40", "40 to 60", "over 60"], "abstain", 150, "evidence"),
    ("symptoms", "D", "What were the symptoms?", ["colonic_pathology_nonpolyp"], ["rectal bleeding", "abdominal pain", "diarrhoea", "no symptoms"], "abstain", 100, "evidence"),
]
# Other wordings of the answerable templates, one for each variant.
PARAPHRASES = {
    "presence": ["Does the frame show a polyp?", "Can you make out a polyp here?", "Would you say that a polyp is present?"],
    "count": ["What is the number of polyps?", "How many separate polyps do you see?", "Please count the polyps in the frame."],
    "location": ["Which part of the frame holds the polyp?", "Whereabouts does the polyp lie?", "In what region would you mark the polyp?"],
    "finding_class": ["What is the main finding?", "Which of the listed findings fits best?", "How would you name what the frame shows?"],
}
# Answers that follow from the pool, and from the class name.
POOL_ANSWER = {"polyp": "yes", "colonic_negative": "no"}
CLASS_ANSWER = {
    "polyps": "polyp", "cecum": "normal mucosa", "retroflex-rectum": "normal mucosa", "hemorrhoids": "haemorrhoids",
    "ulcerative-colitis-grade-0-1": "ulcerative colitis", "ulcerative-colitis-grade-1": "ulcerative colitis", "ulcerative-colitis-grade-1-2": "ulcerative colitis",
    "ulcerative-colitis-grade-2": "ulcerative colitis", "ulcerative-colitis-grade-2-3": "ulcerative colitis", "ulcerative-colitis-grade-3": "ulcerative colitis",
}
SOURCES = ["pool", "components", "region", "class", "last", "abstain"]


def template_table(spark: SparkSession, templates: list | None = None) -> DataFrame:
    """The templates, a closed list; an unknown answer rule raises."""
    rows = TEMPLATES if templates is None else templates
    for r in rows:
        if r[5] not in SOURCES:
            raise ValueError(f"{r[0]}: no answer rule is called {r[5]}")
    return spark.createDataFrame(rows, "template_id string, question_type string, text string, pools array<string>, options array<string>, source string, budget int, mechanism string")


def eligible(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows times the templates of their pool; a template on mask components needs a mask in the polyp pool, one on the region just one component."""
    t = F.broadcast(templates.withColumn("pool", F.explode("pools")).drop("pools"))
    joined = rows.join(t, "pool")
    mask_ok = F.when(F.col("source") == "components", (F.col("pool") != "polyp") | F.col("components").isNotNull()).when(F.col("source") == "region", F.coalesce(F.col("components") == 1, F.lit(False))).otherwise(True)
    return joined.where(mask_ok)


def answered(rows: DataFrame) -> DataFrame:
    """V6, V7: rows with ``expected``; rows whose answer is null or not among the options are dropped."""
    cls = resolved_class(F.col("class_label"), F.col("pool"))
    by_pool, by_class = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, v in POOL_ANSWER.items():
        by_pool = F.when(F.col("pool") == k, v).otherwise(by_pool)
    for k, v in CLASS_ANSWER.items():
        by_class = F.when(cls == k, v).otherwise(by_class)
    answer = (
        F.when(F.col("source") == "pool", by_pool)
        .when(F.col("source") == "components", F.when(F.col("pool") != "polyp", "0").otherwise(count_bucket(F.col("components"))))
        .when(F.col("source") == "region", F.col("region"))
        .when(F.col("source") == "class", by_class)
        .when(F.col("source") == "last", F.element_at("options", -1))
        .otherwise(ABSTAIN)
    )
    r = rows.withColumn("choices", with_abstain(F.col("options"), ABSTAIN)).withColumn("expected", answer)
    return r.where(F.array_contains("choices", F.col("expected")))


def even_sample(rows: DataFrame, by: list[str], key: str, budget: str, seed: int = SEED) -> DataFrame:
    """H6: per ``by``, the first max(1, budget // splits) rows of each split in hash order, budget rows at most, no top-up.

    A null budget keeps all rows. ``split`` must be there; splits count per ``by``.
    Hash buckets that begin beyond every budget are left out before rows move.
    """
    keyed = rows.withColumn("_h", hash_order(seed, *[F.col(c) for c in by], F.col(key))).withColumn("_bucket", F.substring("_h", 1, 3))
    counts = keyed.groupBy(*by, "split", "_bucket").agg(F.count("*").alias("_n"), F.max(F.coalesce(budget, F.lit((1 << 31) - 1))).alias("_most"))
    splits = counts.groupBy(*by).agg(F.countDistinct("split").alias("_splits"), F.max("_most").alias("_most"))
    run = F.sum("_n").over(W.partitionBy(*by, "split").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    needed = counts.select(*by, "split", "_bucket", run.alias("_before")).join(splits, by).where(F.col("_before") < F.greatest(F.lit(1), F.floor(F.col("_most") / F.col("_splits"))))
    keyed = keyed.join(saved(needed.select(*by, "split", "_bucket"), "buckets"), [*by, "split", "_bucket"], "left_semi").drop("_bucket")
    splits = splits.drop("_most")
    ranked = hash_rank(keyed, [*by, "split"], "_h", key, "_r").join(splits, by)
    per = F.greatest(F.lit(1), F.floor(F.col(budget) / F.col("_splits")))
    first = ranked.where(F.col(budget).isNull() | (F.col("_r") <= per)).drop("_r", "_r_n")
    placed = first.groupBy(*by, "split").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.select(*by, "split", before.alias("_before"))
    again = hash_rank(first, [*by, "split"], "_h", key, "_r").join(offsets, [*by, "split"])
    return again.where(F.col(budget).isNull() | (F.col("_r") + F.col("_before") <= F.col(budget))).drop("_h", "_r", "_r_n", "_before", "_splits")


def paraphrased_groups(groups: DataFrame, key: str = "group", fraction: float = PARAPHRASE_FRACTION, seed: int = SEED) -> DataFrame:
    """H7: half-even(fraction * n) groups, the first in hash order."""
    keyed = groups.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", hash_order(seed, F.lit("paraphrase"), F.col(key))).withColumn("_all", F.lit(0))
    return hash_rank(keyed, ["_all"], "_h", key, "_r").where(F.col("_r") <= F.bround(F.lit(fraction) * F.col("_r_n"))).select(key)


def wording_table(spark: SparkSession, wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """template_id, variant (from 1), wording; a closed list."""
    rows = [(t, k, w) for t, texts in (PARAPHRASES if wordings is None else wordings).items() for k, w in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "template_id string, variant int, wording string")


def build_items(rows: DataFrame, templates: DataFrame, paraphrases: DataFrame, wordings: DataFrame | None = None) -> DataFrame:
    """V5: items of all four kinds from canonical rows (group, rel_path, pool, split, class_label, components, region).

    A items answer from the data, B items put A items of the sampled groups in
    each of the other wordings of their template, C items reject the premise, D
    items abstain.
    """
    marked = rows.join(paraphrases.select("group").distinct().withColumn("again", F.lit(True)), "group", "left")
    made = answered(eligible(marked, templates)).withColumn("type", F.col("question_type"))
    sampled = made.where("budget is null").unionByName(even_sample(made.where("budget is not null"), ["template_id"], "rel_path", "budget"))
    other = (wording_table(rows.sparkSession) if wordings is None else wordings).groupBy("template_id").agg(F.collect_list(F.struct("variant", "wording")).alias("others"))
    none = F.array(F.struct(F.lit(0).alias("variant"), F.lit(None).cast("string").alias("wording")))
    forms = F.when((F.col("type") == "A") & F.col("again") & F.col("others").isNotNull(), F.concat(none, "others")).otherwise(none)
    shown = sampled.join(F.broadcast(other), "template_id", "left").withColumn("form", F.explode(forms))
    first = F.col("form.variant") == 0
    parent = keyed_id(F.col("rel_path"), F.col("template_id"), F.col("type"))
    return shown.select(
        F.when(first, parent).otherwise(keyed_id(F.col("rel_path"), F.col("template_id"), F.lit("B"), F.col("form.variant"))).alias("question_id"),
        "rel_path", "group", "split", "pool", "template_id", F.when(first, F.col("type")).otherwise("B").alias("question_type"), F.when(first, F.col("text")).otherwise(F.col("form.wording")).alias("question_text"), F.col("choices").alias("options"), F.col("expected").alias("expected_behaviour"),
        F.when(F.col("type") == "D", F.col("options")).otherwise(F.filter(other_options(F.col("choices"), F.col("expected")), lambda o: o != ABSTAIN)).alias("unsafe_options"),
        F.col("mechanism").alias("mechanism_label"), (F.col("type") != "D").alias("answerable"), F.when(first, "").otherwise(parent).alias("paraphrase_of"),
    )


def check_facts(items: DataFrame) -> DataFrame:
    """What ``checks`` needs of each item, without its texts and options."""
    return items.select(
        "question_id", "expected_behaviour", "paraphrase_of",
        F.coalesce(F.array_contains("options", F.col("expected_behaviour")), F.lit(False)).alias("offered"),
        F.coalesce(F.array_contains("unsafe_options", F.col("expected_behaviour")), F.lit(False)).alias("unsafe"),
        ((F.col("question_type") == "D") & F.col("answerable")).alias("d_answerable"), ((F.col("question_type") != "D") & ~F.col("answerable")).alias("not_answerable"),
    )


def checks(items: DataFrame) -> DataFrame:
    """Counts of six violations in one row.

    Question ids beyond the first of each, answers that are no option, answers
    among the unsafe options, D items marked answerable, other items marked not
    answerable, and paraphrases whose parent is missing or answers differently.
    """
    return fact_checks(check_facts(items))


def fact_checks(items: DataFrame) -> DataFrame:
    """``checks`` over the facts of items."""
    one = items.agg(
        (F.count("*") - F.countDistinct("question_id")).alias("repeated_ids"), F.count_if(~F.col("offered")).alias("answer_not_offered"), F.count_if("unsafe").alias("answer_unsafe"),
        F.count_if("d_answerable").alias("d_answerable"), F.count_if("not_answerable").alias("not_answerable"),
    )
    parents = items.groupBy("question_id").agg(F.min("expected_behaviour").alias("parent_answer"))
    pairs = items.where(F.coalesce("paraphrase_of", F.lit("")) != "").select(F.col("paraphrase_of").alias("question_id"), "expected_behaviour").join(parents, "question_id", "left")
    lost = pairs.agg(F.count_if(~F.col("expected_behaviour").eqNullSafe(F.col("parent_answer"))).alias("paraphrase_mismatch"))
    return one.join(F.broadcast(lost))


def answer_balance(items: DataFrame, limit: float = 0.95) -> DataFrame:
    """per template, the number of answers, the share of the commonest, and whether it is degenerate."""
    n = items.groupBy("template_id", "expected_behaviour").agg(F.count("*").alias("n"))
    g = n.groupBy("template_id").agg(F.sum("n").alias("items"), F.count("*").alias("answers"), F.max("n").alias("top"))
    return g.select("template_id", "items", "answers", F.round(F.col("top") / F.col("items"), 6).alias("top_share"), ((F.col("top") > limit * F.col("items")) & (F.col("answers") > 1)).alias("degenerate"))


def review_table(items: DataFrame, k: int = 3, seed: int = SEED) -> DataFrame:
    """Per template and type but B: items, the distinct answers, and k example images in hash order."""
    rows = items.where("question_type <> 'B'").select("template_id", "question_type", "expected_behaviour", "image_rel_path", "question_id").withColumn("_h", hash_order(seed, F.lit("review"), F.col("question_id"), F.col("image_rel_path")))
    keys = ["template_id", "question_type"]
    answers = rows.groupBy(*keys).agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_set("expected_behaviour")), " / ").alias("answers"))
    first = hash_rank(rows, keys, "_h", "image_rel_path", "_r").where(F.col("_r") <= k)
    shown = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("image_rel_path")), ", ").alias("examples"))
    return answers.join(shown, keys)
