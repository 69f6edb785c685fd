"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations


def _word(c: str) -> str:
    key = rf"lower(regexp_replace({c}, '[\s\x{{00A0}}_\-]+', '', 'g'))"
    return f"CASE WHEN {key} NOT IN ('', 'none', '(none)', 'nan', 'null', 'na', 'n/a', 'nil', 'missing') THEN {key} END"


def _path(c: str) -> str:
    return rf"regexp_replace(trim(replace({c}, '\', '/'), ' ' || chr(9) || chr(10) || chr(13)), '^(\./+)+', '')"


_LATEST = "SELECT * FROM records WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC NULLS LAST) = 1"
_USABLE = "margin IS NOT NULL AND NOT isnan(margin) AND margin >= 0 AND NOT isinf(margin)"

P1_FOUND = f"""
WITH latest AS ({_LATEST}),
bank AS (SELECT question_id, min({_word("pool")}) AS pool, min({_word("question_type")}) AS qt FROM question_bank GROUP BY 1),
items AS (SELECT {_word("l.split")} AS split, b.pool, b.qt FROM latest l JOIN bank b USING (question_id) WHERE b.pool IS NOT NULL AND b.qt IS NOT NULL),
sizes AS (SELECT split, count(*) AS n FROM items WHERE split IS NOT NULL GROUP BY 1),
counts AS (SELECT split, pool, qt, count(*) AS c FROM items GROUP BY 1, 2, 3)
SELECT t.split, t.pool, t.question_type FROM sample_targets t
LEFT JOIN sizes s ON s.split = {_word("t.split")}
LEFT JOIN counts k ON k.split = {_word("t.split")} AND k.pool = {_word("t.pool")} AND k.qt = {_word("t.question_type")}
WHERE coalesce(k.c, 0) < greatest(t.min_items, coalesce(s.n, 0) * t.sample_permille * t.share_permille // 1000000)"""

P1_SAMPLE = f"""
WITH latest AS ({_LATEST}),
bank AS (SELECT question_id, min({_word("pool")}) AS pool, min({_word("question_type")}) AS qt FROM question_bank GROUP BY 1),
items AS (SELECT l.item_id, {_word("l.split")} AS s, b.pool AS p, b.qt AS q FROM latest l JOIN bank b USING (question_id) WHERE b.pool IS NOT NULL AND b.qt IS NOT NULL AND {_word("l.split")} IS NOT NULL),
sizes AS (SELECT s, count(*) AS n FROM items GROUP BY 1),
counts AS (SELECT s, p, q, count(*) AS c FROM items GROUP BY 1, 2, 3),
targets AS (SELECT {_word("split")} AS s, {_word("pool")} AS p, {_word("question_type")} AS q, split, pool, question_type, sample_permille, share_permille, min_items FROM sample_targets),
want AS (SELECT t.*, coalesce(c, 0) AS c, coalesce(n, 0) AS n, coalesce(n, 0) * sample_permille * share_permille AS exact FROM targets t LEFT JOIN sizes USING (s) LEFT JOIN counts USING (s, p, q)),
based AS (SELECT *, least(c, greatest(min_items, exact // 1000000)) AS base, CASE WHEN min_items > exact // 1000000 THEN 0 ELSE exact % 1000000 END AS rest FROM want),
spare AS (SELECT *, c > base AND rest > 0 AS open, greatest(0, n * max(sample_permille) OVER x // 1000 - sum(base) OVER x) AS left_over, row_number() OVER (PARTITION BY s ORDER BY c > base DESC, rest DESC, p, q) AS r FROM based WINDOW x AS (PARTITION BY s)),
quota AS (SELECT *, base + CASE WHEN open AND r <= left_over THEN 1 ELSE 0 END AS quota FROM spare),
drawn AS (SELECT *, row_number() OVER (PARTITION BY s, p, q ORDER BY sha256('0|' || item_id), item_id) AS k FROM items)
SELECT d.item_id, t.split, t.pool, t.question_type FROM drawn d JOIN quota t USING (s, p, q) WHERE d.k <= t.quota"""

P3_FOUND = rf"""
WITH bank AS (SELECT question_id, min(group_id) AS g FROM question_bank GROUP BY 1),
rows AS (SELECT {_word("r.split")} AS split, coalesce(try_cast(nullif(regexp_extract(r.group_id, '(\d+)(?:\.0*)?\s*$', 1), '') AS BIGINT), b.g) AS group_id
  FROM records r LEFT JOIN bank b USING (question_id))
SELECT group_id FROM rows WHERE split IS NOT NULL AND group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1"""

P4_FOUND = f"""
WITH RECURSIVE link AS (SELECT {_path("a")} AS a, {_path("b")} AS b FROM near_pairs WHERE hamming BETWEEN 0 AND 4),
edge AS (SELECT a, b FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b),
reach AS (SELECT DISTINCT a AS rel_path, a AS seen FROM edge UNION SELECT r.rel_path, e.b FROM reach r JOIN edge e ON e.a = r.seen)
SELECT min(seen) AS group_path, rel_path FROM reach GROUP BY rel_path"""

_EDGES = f"""
WITH latest AS ({_LATEST}),
rows AS (SELECT {_word("model")} AS m, {_word("condition")} AS c, item_id, margin FROM latest WHERE {_USABLE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY m, c ORDER BY margin DESC) AS r, count(*) OVER (PARTITION BY m, c) AS n FROM rows WHERE m IS NOT NULL AND c IS NOT NULL),
edges AS (SELECT t.model, t.condition, t.keep_permille, q.m, q.c, coalesce(q.n, 0) AS n, q.margin AS cutoff FROM keep_targets t
  LEFT JOIN ranked q ON q.m = {_word("t.model")} AND q.c = {_word("t.condition")} AND q.r = greatest(1, (q.n * t.keep_permille + 999) // 1000))"""

P6_CUTOFFS = f"{_EDGES} SELECT e.model, e.condition, e.keep_permille, e.n, e.cutoff, count(r.item_id) AS kept FROM edges e LEFT JOIN rows r ON r.m = e.m AND r.c = e.c AND r.margin >= e.cutoff GROUP BY ALL"

P6_FOUND = f"{_EDGES} SELECT r.item_id FROM edges e JOIN rows r ON r.m = e.m AND r.c = e.c AND r.margin >= e.cutoff"

_SHA = "CASE WHEN regexp_matches(lower(trim(sha256)), '^(0x)?[0-9a-f]+$') THEN regexp_replace(lower(trim(sha256)), '^0x', '') END"
_CODE = "CASE WHEN regexp_matches(lower(trim(phash)), '^(0x)?[0-9a-f]{1,16}$') AND NOT regexp_matches(lower(trim(phash)), '^(0x)?0+$') THEN ('0x' || regexp_replace(lower(trim(phash)), '^0x', ''))::UBIGINT END"
_FILES = rf"""splits AS (SELECT image_id, min({_word("split")}) AS split FROM records WHERE {_word("split")} IS NOT NULL AND image_id IS NOT NULL GROUP BY 1),
files AS (SELECT DISTINCT {_path("rel_path")} AS p, dataset, {_SHA} AS sha, {_CODE} AS code,
  CASE WHEN {_path("rel_path")} LIKE 'kvasir-seg/%' THEN 'kvasir-seg/' ELSE 'hyperkvasir/' END || regexp_extract(rel_path, '([^/]+?)(\.[^./]*)?$', 1) AS image_id
  FROM inventory WHERE {_path("rel_path")} NOT LIKE 'kvasir-seg/masks/%' AND coalesce(dataset, '') NOT LIKE '%-masks'),
sided AS (SELECT f.*, s.split, CASE WHEN s.split IN ('train', 'esttrain') THEN 't' WHEN s.split IN ('cal', 'test') THEN 'e' END AS side FROM files f JOIN splits s USING (image_id)),
pairs AS (SELECT least(x.p, y.p) AS a, greatest(x.p, y.p) AS b, min(CASE WHEN x.sha = y.sha THEN 'exact' ELSE 'near' END) AS kind
  FROM sided x JOIN sided y ON x.side = 't' AND y.side = 'e' AND x.p <> y.p AND (x.sha = y.sha OR bit_count(xor(x.code, y.code)) <= 4) GROUP BY 1, 2)"""

P7_FOUND = f"WITH {_FILES} SELECT a, b FROM pairs"

P7_REPORT = f"""
WITH {_FILES},
ends AS (SELECT p, min(kind) AS kind FROM (SELECT a AS p, kind FROM pairs UNION ALL SELECT b, kind FROM pairs) GROUP BY 1),
info AS (SELECT DISTINCT p, dataset, split FROM sided)
SELECT split, dataset, count(DISTINCT p) AS files, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'near') AS near
FROM info LEFT JOIN ends USING (p) GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_sample": P1_SAMPLE, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p6_found": P6_FOUND, "p6_cutoffs": P6_CUTOFFS, "p7_found": P7_FOUND, "p7_report": P7_REPORT}
