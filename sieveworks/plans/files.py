"""Inventory and grouping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.scalars import keyed_id, prompt_id
from sieveworks.operators import grouping, hamming, inventory
from sieveworks.session import cut, table


def _inv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inventory")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return cut(grouping.group_map(_inv(spark, d)))


def classify_rules(spark, d):
    return inventory.classified(_inv(spark, d))


def content_digest(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), keyed_id(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"), prompt_id(t).alias("prompt_id"))


def inventory_counts(spark, d):
    return inventory.counts(_inv(spark, d))


def inventory_categories(spark, d):
    return inventory.categories(_inv(spark, d))


def dimension_summary(spark, d):
    return inventory.dimensions(_inv(spark, d))


def topk_combo(spark, d):
    return inventory.top_sizes(_inv(spark, d))


def size_summary(spark, d):
    return inventory.area_summary(_inv(spark, d))


def pairing_missing(spark, d):
    return inventory.unpaired(_inv(spark, d))


def pairing_mismatch(spark, d):
    return inventory.mismatched(_inv(spark, d))


def mask_lookup(spark, d):
    inv = _inv(spark, d)
    return inventory.find_masks(inv.select("rel_path").distinct(), inv)


def exact_dup_groups(spark, d):
    return inventory.exact_copies(_inv(spark, d))


def near_dup_pairs(spark, d):
    return grouping.near_dup(cut(grouping.hashed_files(_inv(spark, d))), dual=False)


def dual_hash_pairs(spark, d):
    return grouping.near_dup(cut(grouping.hashed_files(_inv(spark, d))))


def near_dup_members(spark, d):
    return grouping.class_members(grouping.hashed_files(_inv(spark, d)))


def cross_within_pairs(spark, d):
    """E4 tag: class pairs whose representatives lie in the same dataset or in two."""
    files = cut(grouping.hashed_files(_inv(spark, d)))
    names = lambda c: files.select(F.col("rel_path").alias(c), F.col("dataset").alias(f"d_{c}"))
    p = grouping.near_dup(files, dual=False).join(names("a"), "a").join(names("b"), "b")
    return p.groupBy(F.when(F.col("d_a") == F.col("d_b"), "within").otherwise("cross").alias("kind")).agg(F.count("*").alias("pairs"), F.sum(F.col("n_a") * F.col("n_b")).alias("file_pairs"))


def components(spark, d):
    return grouping.group_map(_inv(spark, d)).select("rel_path", "group")


def group_profile(spark, d):
    return grouping.profile(_groups(spark, d))


def group_sizes(spark, d):
    return grouping.size_distribution(_groups(spark, d))


def group_examples(spark, d):
    return grouping.largest(_groups(spark, d))


def class_collapse(spark, d):
    return grouping.class_collapse(_groups(spark, d))


def _signs(spark, d):
    """Two codes of every embedding: the signs of its values, and of the sums of neighbours."""
    bits = lambda f: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(f(i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    at = lambda i: F.get("embedding", i).cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits(at).alias("ph"), bits(lambda i: at(i) + at((i + 1) % 64)).alias("dh"))


def embedding_pairs(spark, d):
    """E4 at a distance of 20, on codes that have such pairs."""
    return hamming.near_classes(hamming.code_classes(_signs(spark, d), "id", ["ph"]), 20)


def embedding_dual_pairs(spark, d):
    """E5 at a distance of 20 in both codes."""
    return hamming.near_classes(hamming.code_classes(_signs(spark, d), "id", ["ph", "dh"]), 20, "ph", "dh")


def threshold_sweep(spark, d):
    return grouping.threshold_sweep(_inv(spark, d))


_STEM = r"regexp_extract({}, '([^/]+?)(\.[^./]*)?$', 1)"
_HEX = "regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '^0x', '')"
_SHA = f"CASE WHEN regexp_matches({_HEX.format('sha256')}, '^[0-9a-f]+$') THEN {_HEX.format('sha256')} END"


def _code(c: str) -> str:
    h = _HEX.format(c)
    return f"CASE WHEN regexp_matches({h}, '^[0-9a-f]{{1,16}}$') AND NOT regexp_matches({h}, '^0+$') THEN ('0x' || {h})::UBIGINT END"


#: Codes as signed 64-bit values, as repeated scans are told apart by their order. Only scans with both codes count.
def _signed(c: str) -> str:
    return f"CASE WHEN ({c})::HUGEINT >= 9223372036854775808 THEN (({c})::HUGEINT - 18446744073709551616)::BIGINT ELSE ({c})::BIGINT END"


_HASHED = f"""
scans AS (SELECT rel_path, dataset, class_label, {_SHA} AS sha, {_code("phash")} AS p, {_code("dhash")} AS q FROM inventory),
signed AS (SELECT rel_path, dataset, class_label, sha, p, q, {_signed("p")} AS sp, {_signed("q")} AS sq FROM scans),
hashed AS (SELECT rel_path, min(dataset) AS dataset, min(class_label) AS class_label, min(sha) AS sha,
  (array_agg(p ORDER BY sp, sq) FILTER (sp IS NOT NULL AND sq IS NOT NULL))[1] AS ph, (array_agg(q ORDER BY sp, sq) FILTER (sp IS NOT NULL AND sq IS NOT NULL))[1] AS dh FROM signed GROUP BY rel_path),
files AS (SELECT * FROM hashed WHERE ph IS NOT NULL AND dh IS NOT NULL)"""
_NEAR1 = """
classes AS (SELECT ph, min(rel_path) AS rep, count(*) AS n FROM files GROUP BY ph),
near AS (SELECT x.rep AS a, y.rep AS b, x.n AS n_a, y.n AS n_b, bit_count(xor(x.ph, y.ph))::INTEGER AS dist FROM classes x JOIN classes y ON x.rep < y.rep AND bit_count(xor(x.ph, y.ph)) <= 4)"""


def _near2(t: int) -> str:
    return f"""
classes AS (SELECT ph, dh, min(rel_path) AS rep, count(*) AS n FROM files GROUP BY ph, dh),
near AS (SELECT x.rep AS a, y.rep AS b, x.n AS n_a, y.n AS n_b, greatest(bit_count(xor(x.ph, y.ph)), bit_count(xor(x.dh, y.dh)))::INTEGER AS dist
  FROM classes x JOIN classes y ON x.rep < y.rep AND bit_count(xor(x.ph, y.ph)) <= {t} AND bit_count(xor(x.dh, y.dh)) <= {t})"""


_REST = """
rest AS (SELECT c.rep AS a, f.rel_path AS b FROM files f JOIN classes c USING (ph, dh)
  UNION SELECT min(rel_path) OVER (PARTITION BY sha), rel_path FROM files WHERE sha IS NOT NULL)"""
_BITS = "list_sum(list_transform(range(64), lambda i: CASE WHEN {} > 0 THEN (1::UBIGINT << i::INTEGER)::HUGEINT ELSE 0::HUGEINT END))::UBIGINT"
_SIGNS = f"signs AS (SELECT vec_id AS id, {_BITS.format('embedding[i + 1]')} AS ph, {_BITS.format('(embedding[i + 1]::DOUBLE + embedding[(i + 1) % 64 + 1]::DOUBLE)')} AS dh FROM embeddings)"
_GROUPS = f"""WITH RECURSIVE {_HASHED}, {_near2(4)}, {_REST},
half AS (SELECT a, b FROM near UNION SELECT a, b FROM rest),
edge AS (SELECT a, b FROM half WHERE a <> b UNION SELECT b, a FROM half WHERE a <> b),
reach AS (SELECT rel_path AS v, rel_path AS seen FROM files UNION SELECT r.v, e.b FROM reach r JOIN edge e ON e.a = r.seen),
comp AS (SELECT v AS rel_path, min(seen) AS grp FROM reach GROUP BY v),
gm AS (SELECT f.rel_path, f.class_label, c.grp FROM files f JOIN comp c USING (rel_path))"""
_SWEEP = f"""WITH RECURSIVE {_HASHED}, {_near2(12)}, {_REST},
ts AS (SELECT unnest([0, 2, 4, 6, 8, 10, 12])::INTEGER AS t),
half AS (SELECT t, a, b FROM ts, near WHERE dist <= t UNION SELECT t, a, b FROM ts, rest),
edge AS (SELECT t, a, b FROM half WHERE a <> b UNION SELECT t, b, a FROM half WHERE a <> b),
reach AS (SELECT t, rel_path AS v, rel_path AS seen FROM ts, files UNION SELECT r.t, r.v, e.b FROM reach r JOIN edge e ON e.a = r.seen AND e.t = r.t),
comp AS (SELECT t, v, min(seen) AS grp FROM reach GROUP BY t, v),
sizes AS (SELECT t, grp, count(*) AS n FROM comp GROUP BY t, grp),
p AS (SELECT t, coalesce(sum(n_a * n_b) FILTER (dist <= t), 0) AS across FROM ts, near GROUP BY t),
i AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS inside FROM classes)
SELECT s.t AS threshold, (coalesce(max(across), 0) + max(inside))::BIGINT AS pairs, count(*) AS groups, count(*) FILTER (n > 1) AS multi, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS in_multi, max(n) AS largest
FROM sizes s LEFT JOIN p ON p.t = s.t, i GROUP BY s.t"""
_RULE = """CASE WHEN low LIKE '%kvasir-seg%' AND low LIKE '%masks%' THEN 'kvasir-seg-masks' WHEN low LIKE '%kvasir-seg%' AND low LIKE '%images%' THEN 'kvasir-seg-images'
  WHEN low LIKE '%labeled-images%' THEN 'hyperkvasir-labeled' WHEN low LIKE '%segmented-images%' THEN 'hyperkvasir-segmented' ELSE 'unclassified' END"""
_SIDES = f"""
a AS (SELECT {_STEM.format("rel_path")} AS stem, max(width) AS image_w, max(height) AS image_h FROM inventory WHERE dataset = 'kvasir-seg-images' GROUP BY 1),
b AS (SELECT {_STEM.format("rel_path")} AS stem, max(width) AS mask_w, max(height) AS mask_h FROM inventory WHERE dataset = 'kvasir-seg-masks' GROUP BY 1)"""

SQL = {
    "classify_rules": f"""WITH r AS (SELECT rel_path, lower(rel_path) AS low FROM inventory), k AS (SELECT rel_path, {_RULE} AS rule FROM r)
SELECT rel_path, rule, CASE WHEN rule NOT LIKE 'kvasir-seg%' AND len(string_split(rel_path, '/')) >= 2 THEN string_split(rel_path, '/')[-2] END AS label, {_STEM.format("rel_path")} AS stem FROM k""",
    "content_digest": """SELECT doc_id, sha256(coalesce(text, '')) AS digest, sha256(doc_id || '|' || coalesce(source, '') || '|' || coalesce(text, ''))[:16] AS key, 'p' || sha256(coalesce(text, ''))[:10] AS prompt_id FROM documents""",
    "inventory_counts": "SELECT dataset || '/' || coalesce(class_label, 'None') AS key, count(*) AS files, count(*) FILTER (NOT readable) AS unreadable FROM inventory GROUP BY 1",
    "inventory_categories": " UNION ALL ".join(f"SELECT '{c}' AS column, coalesce({c}, 'None') AS value, count(*) AS files FROM inventory GROUP BY 2" for c in ("dataset", "format", "mode", "mask_centroid_quadrant")),
    "dimension_summary": "SELECT min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height, count(DISTINCT (width, height)) AS sizes, round_even(sum(bytes) / 1e9, 6) AS gb FROM inventory WHERE readable",
    "topk_combo": "SELECT width, height, count(*) AS n FROM inventory WHERE readable GROUP BY 1, 2 ORDER BY n DESC, width, height LIMIT 10",
    "size_summary": """SELECT count(*) AS n, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS greatest, count(*) FILTER (x > 0.4) AS above_limit
FROM (SELECT mask_area_frac AS x FROM inventory WHERE mask_area_frac >= 0 AND NOT isnan(mask_area_frac))""",
    "pairing_missing": f"WITH {_SIDES} SELECT 'image' AS side, stem FROM a ANTI JOIN b USING (stem) UNION ALL SELECT 'mask', stem FROM b ANTI JOIN a USING (stem)",
    "pairing_mismatch": f"WITH {_SIDES} SELECT stem, image_w, image_h, mask_w, mask_h FROM a JOIN b USING (stem) WHERE image_w <> mask_w OR image_h <> mask_h",
    "mask_lookup": """WITH f AS (SELECT DISTINCT rel_path FROM inventory), w AS (SELECT rel_path, array_to_string(list_transform(string_split(rel_path, '/'), lambda p: CASE WHEN p = 'images' THEN 'masks' ELSE p END), '/') AS mask_path FROM f)
SELECT rel_path, mask_path FROM w WHERE mask_path <> rel_path AND mask_path IN (SELECT rel_path FROM f)""",
    "exact_dup_groups": f"WITH d AS (SELECT DISTINCT rel_path, {_SHA} AS sha FROM inventory) SELECT sha, count(*) AS files, min(rel_path) AS first_path FROM d WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) > 1",
    "near_dup_pairs": f"WITH {_HASHED}, {_NEAR1} SELECT * FROM near",
    "dual_hash_pairs": f"WITH {_HASHED}, {_near2(4)} SELECT * FROM near",
    "embedding_pairs": f"WITH {_SIGNS}, c AS (SELECT ph, min(id) AS rep, count(*) AS n FROM signs GROUP BY ph) SELECT x.rep AS a, y.rep AS b, x.n AS n_a, y.n AS n_b, bit_count(xor(x.ph, y.ph))::INTEGER AS dist FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.ph, y.ph)) <= 20",
    "embedding_dual_pairs": f"WITH {_SIGNS}, c AS (SELECT ph, dh, min(id) AS rep, count(*) AS n FROM signs GROUP BY ph, dh) SELECT x.rep AS a, y.rep AS b, x.n AS n_a, y.n AS n_b, greatest(bit_count(xor(x.ph, y.ph)), bit_count(xor(x.dh, y.dh)))::INTEGER AS dist FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.ph, y.ph)) <= 20 AND bit_count(xor(x.dh, y.dh)) <= 20",
    "near_dup_members": f"WITH {_HASHED} SELECT rel_path, min(rel_path) OVER (PARTITION BY ph, dh) AS rep FROM files",
    "cross_within_pairs": f"WITH {_HASHED}, {_NEAR1} SELECT CASE WHEN x.dataset = y.dataset THEN 'within' ELSE 'cross' END AS kind, count(*) AS pairs, sum(n_a * n_b)::BIGINT AS file_pairs FROM near JOIN files x ON x.rel_path = a JOIN files y ON y.rel_path = b GROUP BY 1",
    "components": f"{_GROUPS} SELECT rel_path, grp AS \"group\" FROM gm",
    "group_profile": f"{_GROUPS}, s AS (SELECT count(*) AS n FROM gm GROUP BY grp) SELECT sum(n)::BIGINT AS images, count(*) AS groups, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS in_multi, max(n) AS largest FROM s",
    "group_sizes": f"{_GROUPS}, s AS (SELECT count(*) AS size FROM gm GROUP BY grp) SELECT size, count(*) AS groups FROM s GROUP BY size",
    "group_examples": f"""{_GROUPS}, top AS (SELECT grp, count(*) AS n FROM gm GROUP BY grp HAVING count(*) > 1 ORDER BY n DESC, grp LIMIT 10),
c AS (SELECT t.grp, t.n, coalesce(class_label, '(none)') || '=' || count(*) AS x FROM gm g JOIN top t ON g.grp = t.grp GROUP BY t.grp, t.n, coalesce(class_label, '(none)')),
r AS (SELECT g.grp, rel_path, row_number() OVER (PARTITION BY g.grp ORDER BY rel_path) AS i FROM gm g JOIN top t ON g.grp = t.grp)
SELECT c.grp AS "group", c.n, string_agg(c.x, ',' ORDER BY c.x) AS classes, (SELECT string_agg(rel_path, ',' ORDER BY rel_path) FROM r WHERE r.grp = c.grp AND i <= 4) AS paths FROM c GROUP BY c.grp, c.n""",
    "class_collapse": f"{_GROUPS} SELECT coalesce(class_label, '(none)') AS class_label, count(*) AS images, count(DISTINCT grp) AS groups, round(100 * (1 - count(DISTINCT grp) / count(*)), 3) AS collapse_pct FROM gm GROUP BY 1",
    "threshold_sweep": _SWEEP,
}


def queries() -> dict:
    return {f.__name__: f for f in (classify_rules, content_digest, inventory_counts, inventory_categories, dimension_summary, topk_combo, size_summary, pairing_missing, pairing_mismatch, mask_lookup, exact_dup_groups, near_dup_pairs, dual_hash_pairs, embedding_pairs, embedding_dual_pairs, near_dup_members, cross_within_pairs, components, group_profile, group_sizes, group_examples, class_collapse, threshold_sweep)}
