"""Pools, strata, splits and question banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.normal import hex_digest, word
from sieveworks.functions.scalars import stem
from sieveworks.operators import bank, grouping, pools
from sieveworks.session import cut, saved, table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Images with pool and group: exact and near copies, directly or through others, named after the least digest (path of a file without one)."""
    inv = table(spark, d, "inventory").where(F.col("readable") & ~F.col("dataset").endswith("-masks"))
    rows = inv.groupBy("rel_path").agg(F.min("dataset").alias("dataset"), F.min("class_label").alias("class_label"), F.min(hex_digest("sha256")).alias("sha"))
    rows = rows.select("rel_path", "dataset", F.when(F.col("dataset") == "kvasir-seg-images", "polyps").otherwise(F.col("class_label")).alias("class_label"), F.coalesce("sha", "rel_path").alias("key"))
    rows = cut(rows)
    groups = grouping.linked_keys(inv, rows.select("rel_path", "key"))
    return cut(pools.row_pools(rows.drop("key").join(groups, "rel_path")))


def class_pools(spark, d):
    return pools.class_table(spark)


def majority_pool(spark, d):
    return pools.group_pools(_rows(spark, d))


def pool_conflicts(spark, d):
    return pools.group_pools(_rows(spark, d)).where("pools > 1").select("group", "pool", "pools", "dropped")


def pool_histogram(spark, d):
    """how many groups touch how many pools."""
    return pools.group_pools(_rows(spark, d)).groupBy("pools").agg(F.count("*").alias("groups"), F.sum("dropped").alias("dropped"))


def mask_coverage(spark, d):
    """Canonical images with and without a readable mask, per pool."""
    canon = pools.canonical_rows(_usable(spark, d)).withColumn("stem", stem(F.col("rel_path"))).join(_facts(spark, d), "stem", "left")
    return canon.groupBy("pool").agg(F.count("components").alias("with_mask"), F.count_if(F.col("components").isNull()).alias("without_mask"))


def exclude_laundered(spark, d):
    rows = _rows(spark, d)
    return pools.laundered(rows, pools.group_pools(rows))


def _usable(spark, d):
    rows = _rows(spark, d)
    return cut(pools.usable(rows, pools.group_pools(rows)))


def usable_rows(spark, d):
    return _usable(spark, d).select("rel_path", "group", "pool")


def tertile_bins(spark, d):
    areas = pools.mask_areas(table(spark, d, "inventory"))
    s = pools.strata(_usable(spark, d), areas)
    return s.groupBy("stratum").agg(F.count("*").alias("groups"))


def _split(spark, d, rows):
    s = cut(pools.strata(rows, pools.mask_areas(table(spark, d, "inventory"))))
    return pools.stratified_split(s, "group", "stratum")


def stratified_split(spark, d):
    return _split(spark, d, _usable(spark, d)).select("group", "stratum", "split")


def split_pivot(spark, d):
    return pools.split_counts(_split(spark, d, _usable(spark, d)))


def split_images(spark, d):
    """F16: images and groups per split."""
    rows = _usable(spark, d)
    r = rows.select("rel_path", "group").join(_split(spark, d, rows).select("group", "split"), "group")
    return r.groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("group").alias("groups"))


def split_invariants(spark, d):
    rows = _usable(spark, d)
    r = rows.select("group", "pool").join(_split(spark, d, rows).select("group", "split"), "group", "left")
    return pools.split_violations(r)


def canonical_row(spark, d):
    return pools.canonical_rows(_usable(spark, d)).select("group", "rel_path", "pool", "dataset")


def _facts(spark, d):
    """Mask facts by stem: a mask that is not empty counts as one component; its quadrant names the region."""
    masks = table(spark, d, "inventory").where(F.col("dataset").endswith("-masks") & F.col("readable") & (F.col("mask_area_frac") >= 0))
    q = F.regexp_replace(F.regexp_replace(F.regexp_replace("mask_centroid_quadrant", "^top", "upper"), "^bottom", "lower"), "-", " ")
    return masks.groupBy(stem(F.col("rel_path")).alias("stem")).agg(F.max(F.when(F.col("mask_empty"), 0).otherwise(1)).alias("components"), F.max(q).alias("region"))


def _items(spark, d):
    usable = _usable(spark, d)
    canon = pools.canonical_rows(usable).join(_split(spark, d, usable).select("group", "split"), "group")
    rows = cut(canon.withColumn("stem", stem(F.col("rel_path"))).join(_facts(spark, d), "stem", "left").drop("stem"))
    return bank.build_items(rows, bank.template_table(spark), bank.paraphrased_groups(rows))


def question_items(spark, d):
    r = _items(spark, d)
    return r.withColumn("options", F.array_join("options", "|")).withColumn("unsafe_options", F.array_join("unsafe_options", "|"))


def built_checks(spark, d):
    return bank.fact_checks(saved(bank.check_facts(_items(spark, d)), "facts"))


def _bank(spark, d):
    return table(spark, d, "question_bank").withColumn("question_type", F.upper(word("question_type")))


def bank_checks(spark, d):
    return bank.checks(_bank(spark, d))


def answer_balance(spark, d):
    return bank.answer_balance(_bank(spark, d))


def template_review(spark, d):
    return bank.review_table(_bank(spark, d))


def mechanism_counts(spark, d):
    """F1 over the bank: items by type, mechanism and pool (null kept)."""
    return _bank(spark, d).groupBy("question_type", "mechanism_label", word("pool").alias("pool")).agg(F.count("*").alias("items"))


def even_sample(spark, d):
    """H6 over the bank: per question type 400 groups at most, one question of each group, spread over the splits."""
    rows = _bank(spark, d).select("question_id", "group_id", "question_type", word("split").alias("split")).where("split is not null and group_id is not null")
    one = rows.groupBy("question_type", "group_id").agg(F.min(F.struct("question_id", "split")).alias("x")).select("question_type", "group_id", "x.question_id", "x.split", F.lit(400).alias("budget"))
    return bank.even_sample(one, ["question_type"], "question_id", "budget").select("question_type", "group_id", "question_id", "split")


def paraphrase_groups(spark, d):
    return bank.paraphrased_groups(table(spark, d, "question_bank"), "group_id")


_W = "CASE WHEN {k} NOT IN ('', 'none', '(none)', 'nan', 'null', 'na', 'n/a', 'nil', 'missing') THEN {k} END"


def _word(c: str) -> str:
    return _W.format(k=f"lower(regexp_replace({c}, '[\\s\\x{{00A0}}_\\-]+', '', 'g'))")


_HEX = "regexp_replace(lower(regexp_replace(sha256, '\\s+', '', 'g')), '^0x', '')"
_STEM = r"regexp_extract({}, '([^/]+?)(\.[^./]*)?$', 1)"
_CLASSES = "(VALUES " + ", ".join(f"('{c}', '{p}', '{r}')" for p, (r, cs) in pools.POOLS.items() for c in cs) + ") AS t(class_label, pool, role)"
_BASE = f"""
cls AS (SELECT * FROM {_CLASSES}),
img AS (SELECT rel_path, min(dataset) AS dataset, min(class_label) AS cl, min(CASE WHEN regexp_matches({_HEX}, '^[0-9a-f]+$') THEN {_HEX} END) AS sha
  FROM inventory WHERE readable AND dataset NOT LIKE '%-masks' GROUP BY rel_path),
lab AS (SELECT rel_path, dataset, CASE WHEN dataset = 'kvasir-seg-images' THEN 'polyps' ELSE cl END AS class_label, coalesce(sha, rel_path) AS grp FROM img),
rows AS (SELECT l.*, CASE WHEN dataset = 'kvasir-seg-images' THEN 'polyp' ELSE coalesce(c.pool, 'unassigned') END AS pool, coalesce(c.role = 'excluded', false) AND dataset <> 'kvasir-seg-images' AS excluded
  FROM lab l LEFT JOIN cls c USING (class_label)),
cnt AS (SELECT grp, pool, excluded, count(*) AS n FROM rows GROUP BY ALL),
best AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY grp ORDER BY excluded, pool <> 'polyp', n DESC, pool) = 1),
gp AS (SELECT b.grp, b.pool, b.excluded, count(*) AS pools, (CASE WHEN b.excluded THEN 0 ELSE coalesce(sum(c.n) FILTER (c.excluded), 0) END)::BIGINT AS dropped
  FROM best b JOIN cnt c USING (grp) GROUP BY b.grp, b.pool, b.excluded),
ok AS (SELECT r.rel_path, r.dataset, r.class_label, r.grp, g.pool FROM rows r JOIN gp g USING (grp) WHERE NOT r.excluded AND NOT g.excluded),
areas AS (SELECT {_STEM.format("rel_path")} AS stem, arg_max(mask_area_frac, (rel_path, mask_area_frac)) AS area FROM inventory WHERE dataset LIKE '%-masks' AND mask_area_frac >= 0 AND NOT isnan(mask_area_frac) GROUP BY 1),
cuts AS (SELECT quantile_cont(area, 1.0::DOUBLE / 3) AS t1, quantile_cont(area, 2.0::DOUBLE / 3) AS t2 FROM areas),
bins AS (SELECT stem, CASE WHEN area <= t1 THEN 'small' WHEN area <= t2 THEN 'mid' ELSE 'large' END AS bin FROM areas, cuts),
mem AS (SELECT o.*, coalesce(o.class_label, '(none)') AS cl, b.bin FROM ok o LEFT JOIN bins b ON b.stem = {_STEM.format("o.rel_path")}),
m1 AS (SELECT grp, pool, cl FROM (SELECT grp, pool, cl, count(*) AS n, min(rel_path) AS f FROM mem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) = 1),
m2 AS (SELECT grp, bin FROM (SELECT grp, bin, count(*) AS n, min(rel_path) AS f FROM mem WHERE bin IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) = 1),
strata AS (SELECT m1.grp, m1.pool, m1.pool || '|' || cl || '|' || CASE WHEN m1.pool = 'polyp' THEN coalesce(bin, 'nomask') ELSE '-' END AS stratum FROM m1 LEFT JOIN m2 USING (grp)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{pools.SEED}|' || stratum || '|' || grp), grp) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM strata),
splits AS (SELECT *, CASE WHEN n = 1 THEN 'est_train' WHEN r <= round_even(0.25::DOUBLE * n, 0) THEN 'train' WHEN r <= round_even(0.55::DOUBLE * n, 0) THEN 'est_train' WHEN r <= round_even(0.75::DOUBLE * n, 0) THEN 'cal' ELSE 'test' END AS split FROM ranked),
canon AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY grp ORDER BY NOT (pool = 'polyp' AND dataset = 'kvasir-seg-images'), rel_path) = 1)"""
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_TEMPLATES = "(VALUES " + ", ".join(f"('{t}', '{q}', '{x}', {_LIST(p)}, {_LIST(o)}, '{s}', {b if b else 'NULL::INTEGER'}, '{m}')" for t, q, x, p, o, s, b, m in bank.TEMPLATES) + ") AS t(template_id, question_type, text, pools, options, source, budget, mechanism)"
_WORDINGS = "(VALUES " + ", ".join(f"('{t}', {k}, '{w}')" for t, texts in bank.PARAPHRASES.items() for k, w in enumerate(texts, 1)) + ") AS w(template_id, k, wording)"
_POOL_CASE = "CASE r.pool " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in bank.POOL_ANSWER.items()) + " END"
_CLASS_CASE = "CASE " + " ".join(f"WHEN coalesce(nullif(r.class_label, ''), CASE WHEN r.pool = 'polyp' THEN 'polyps' ELSE '' END) = '{k}' THEN '{v}'" for k, v in bank.CLASS_ANSWER.items()) + " END"
_ITEMS = f"""WITH {_BASE},
facts AS (SELECT {_STEM.format("rel_path")} AS stem, max(CASE WHEN mask_empty THEN 0 ELSE 1 END) AS components, max(replace(regexp_replace(regexp_replace(mask_centroid_quadrant, '^top', 'upper'), '^bottom', 'lower'), '-', ' ')) AS region
  FROM inventory WHERE dataset LIKE '%-masks' AND readable AND mask_area_frac >= 0 GROUP BY 1),
crows AS (SELECT c.grp, c.rel_path, c.class_label, c.pool, s.split, f.components, f.region FROM canon c JOIN splits s USING (grp) LEFT JOIN facts f ON f.stem = {_STEM.format("c.rel_path")}),
tpl AS (SELECT * FROM {_TEMPLATES}),
joined AS (SELECT r.*, t.*, CASE t.source WHEN 'pool' THEN {_POOL_CASE} WHEN 'components' THEN CASE WHEN r.pool <> 'polyp' THEN '0' WHEN components <= 0 THEN '0' WHEN components = 1 THEN '1' WHEN components >= 2 THEN '2 or more' END
    WHEN 'region' THEN region WHEN 'class' THEN {_CLASS_CASE} WHEN 'last' THEN t.options[-1] ELSE '{bank.ABSTAIN}' END AS expected
  FROM crows r JOIN tpl t ON list_contains(t.pools, r.pool)
  WHERE CASE t.source WHEN 'components' THEN r.pool <> 'polyp' OR components IS NOT NULL WHEN 'region' THEN coalesce(components = 1, false) ELSE true END),
made AS (SELECT *, list_append(options, '{bank.ABSTAIN}') AS choices FROM joined),
valid AS (SELECT *, sha256('{bank.SEED}|' || template_id || '|' || rel_path) AS h FROM made WHERE list_contains(choices, expected)),
ns AS (SELECT template_id, count(DISTINCT split) AS k FROM valid GROUP BY 1),
cut1 AS (SELECT * FROM (SELECT v.*, k, row_number() OVER (PARTITION BY v.template_id, split ORDER BY h, rel_path) AS r1 FROM valid v JOIN ns USING (template_id)) WHERE budget IS NULL OR r1 <= greatest(1, budget // k)),
cut2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY split, h, rel_path) AS r2 FROM cut1) WHERE budget IS NULL OR r2 <= budget),
base AS (SELECT sha256(rel_path || '|' || template_id || '|' || question_type)[:16] AS question_id, rel_path, grp AS "group", split, pool, template_id, question_type, text AS question_text, array_to_string(choices, '|') AS options, expected AS expected_behaviour,
  array_to_string(CASE WHEN question_type = 'D' THEN options ELSE list_filter(choices, lambda o: o <> expected AND o <> '{bank.ABSTAIN}') END, '|') AS unsafe_options, mechanism AS mechanism_label, question_type <> 'D' AS answerable, '' AS paraphrase_of FROM cut2),
pg AS (SELECT grp FROM (SELECT grp, row_number() OVER (ORDER BY sha256('{bank.SEED}|paraphrase|' || grp), grp) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM crows)) WHERE r <= round_even(0.25::DOUBLE * n, 0)),
again AS (SELECT sha256(rel_path || '|' || template_id || '|B|' || k)[:16] AS question_id, rel_path, "group", split, pool, template_id, 'B' AS question_type, wording AS question_text, options, expected_behaviour, unsafe_options, mechanism_label, answerable, question_id AS paraphrase_of
  FROM base JOIN {_WORDINGS} USING (template_id) WHERE question_type = 'A' AND "group" IN (SELECT grp FROM pg)),
items AS (SELECT * FROM base UNION ALL SELECT * FROM again)"""
_QB = f"qb AS (SELECT * REPLACE (upper({_word('question_type')}) AS question_type) FROM question_bank)"


def _checks(src: str, opts: str, unsafe: str) -> str:
    return f"""one AS (SELECT count(*) - count(DISTINCT question_id) AS repeated_ids, count(*) FILTER (NOT coalesce(list_contains({opts}, expected_behaviour), false)) AS answer_not_offered,
  count(*) FILTER (coalesce(list_contains({unsafe}, expected_behaviour), false)) AS answer_unsafe, count(*) FILTER (question_type = 'D' AND answerable) AS d_answerable, count(*) FILTER (question_type <> 'D' AND NOT answerable) AS not_answerable FROM {src}),
parents AS (SELECT question_id, min(expected_behaviour) AS pa FROM {src} GROUP BY 1),
lost AS (SELECT count(*) AS paraphrase_mismatch FROM {src} q LEFT JOIN parents p ON p.question_id = q.paraphrase_of WHERE coalesce(q.paraphrase_of, '') <> '' AND q.expected_behaviour IS DISTINCT FROM p.pa)
SELECT * FROM one, lost"""


SQL = {
    "class_pools": f"SELECT class_label, pool, role FROM {_CLASSES}",
    "majority_pool": f'WITH {_BASE} SELECT grp AS "group", pool, excluded, pools, dropped FROM gp',
    "pool_conflicts": f'WITH {_BASE} SELECT grp AS "group", pool, pools, dropped FROM gp WHERE pools > 1',
    "pool_histogram": f"WITH {_BASE} SELECT pools, count(*) AS groups, sum(dropped)::BIGINT AS dropped FROM gp GROUP BY pools",
    "mask_coverage": f"""WITH {_BASE}, stems AS (SELECT DISTINCT {_STEM.format("rel_path")} AS stem FROM inventory WHERE dataset LIKE '%-masks' AND readable AND mask_area_frac >= 0)
SELECT pool, count(s.stem) AS with_mask, count(*) FILTER (s.stem IS NULL) AS without_mask FROM canon c LEFT JOIN stems s ON s.stem = {_STEM.format("c.rel_path")} GROUP BY pool""",
    "exclude_laundered": f"WITH {_BASE} SELECT r.class_label, count(*) AS rows FROM rows r JOIN gp g USING (grp) WHERE r.excluded AND NOT g.excluded GROUP BY 1",
    "usable_rows": f'WITH {_BASE} SELECT rel_path, grp AS "group", pool FROM ok',
    "tertile_bins": f"WITH {_BASE} SELECT stratum, count(*) AS groups FROM strata GROUP BY 1",
    "stratified_split": f'WITH {_BASE} SELECT grp AS "group", stratum, split FROM splits',
    "split_pivot": f"WITH {_BASE} SELECT pool, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'est_train') AS est_train, count(*) FILTER (split = 'cal') AS cal, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM splits GROUP BY pool",
    "split_images": f"WITH {_BASE} SELECT split, count(*) AS images, count(DISTINCT grp) AS groups FROM ok JOIN splits USING (grp) GROUP BY split",
    "split_invariants": f"WITH {_BASE}, r AS (SELECT o.grp, o.pool, s.split FROM ok o LEFT JOIN splits s USING (grp)), p AS (SELECT grp, count(DISTINCT split) AS a, count(DISTINCT pool) AS b FROM r GROUP BY 1) SELECT count(*) FILTER (a > 1) AS groups_split, count(*) FILTER (b > 1) AS groups_pooled, (SELECT count(*) FROM r WHERE split IS NULL) AS rows_without_split FROM p",
    "canonical_row": f'WITH {_BASE} SELECT grp AS "group", rel_path, pool, dataset FROM canon',
    "question_items": f"{_ITEMS} SELECT * FROM items",
    "built_checks": f"{_ITEMS}, li AS (SELECT * REPLACE (string_split(options, '|') AS options, string_split(unsafe_options, '|') AS unsafe_options) FROM items), {_checks('li', 'options', 'unsafe_options')}",
    "bank_checks": f"WITH {_QB}, {_checks('qb', 'options', 'unsafe_options')}",
    "answer_balance": f"WITH {_QB}, n AS (SELECT template_id, expected_behaviour, count(*) AS n FROM qb GROUP BY 1, 2) SELECT template_id, sum(n)::BIGINT AS items, count(*) AS answers, round(max(n) / sum(n), 6) AS top_share, max(n) > 0.95 * sum(n) AND count(*) > 1 AS degenerate FROM n GROUP BY 1",
    "template_review": f"""WITH {_QB}, rows AS (SELECT *, row_number() OVER (PARTITION BY template_id, question_type ORDER BY sha256('{bank.SEED}|review|' || question_id || '|' || image_rel_path), image_rel_path) AS r FROM qb WHERE question_type <> 'B')
SELECT template_id, question_type, count(*) AS items, array_to_string(list_sort(list(DISTINCT expected_behaviour)), ' / ') AS answers, array_to_string(list_sort(list(image_rel_path) FILTER (r <= 3)), ', ') AS examples FROM rows GROUP BY 1, 2""",
    "mechanism_counts": f"WITH {_QB} SELECT question_type, mechanism_label, {_word('pool')} AS pool, count(*) AS items FROM qb GROUP BY ALL",
    "even_sample": f"""WITH {_QB}, rows AS (SELECT question_id, group_id, question_type, {_word('split')} AS split FROM qb),
one AS (SELECT * FROM rows WHERE split IS NOT NULL AND group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_type, group_id ORDER BY question_id, split) = 1),
h AS (SELECT *, sha256('{bank.SEED}|' || question_type || '|' || question_id) AS h, (SELECT count(DISTINCT split) FROM one o WHERE o.question_type = one.question_type) AS k FROM one),
c1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question_type, split ORDER BY h, question_id) <= greatest(1, 400 // k)),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY split, h, question_id) <= 400)
SELECT question_type, group_id, question_id, split FROM c2""",
    "paraphrase_groups": f"SELECT group_id FROM (SELECT group_id, row_number() OVER (ORDER BY sha256('{bank.SEED}|paraphrase|' || group_id), group_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM question_bank WHERE group_id IS NOT NULL)) WHERE r <= round_even(0.25::DOUBLE * n, 0)",
}


def queries() -> dict:
    return {f.__name__: f for f in (class_pools, majority_pool, pool_conflicts, pool_histogram, mask_coverage, exclude_laundered, usable_rows, tertile_bins, stratified_split, split_pivot, split_images, split_invariants, canonical_row, question_items, built_checks, bank_checks, answer_balance, template_review, mechanism_counts, even_sample, paraphrase_groups)}
