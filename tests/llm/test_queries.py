"""The registered queries against DuckDB on the smallest tables, and against brute force where SQL can't tell."""

import os

import pytest

from sieveworks.llm import queries, quota_sample, sql, tokens
from tests.compare import DATA, check, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, name):
    check(spark, queries.queries()[name], sql.oracle_sql()[name])


def test_every_problem_has_queries():
    assert {n.split("_")[0] for n in queries.queries()} == {f"p{i}" for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)}


def test_token_queries(spark):
    texts = dict(connection().sql("select doc_id, text from documents").fetchall())
    ids = {r["doc_id"]: list(r["ids"]) for r in queries.p8_ids(spark, DATA).collect()}
    assert set(ids) == set(texts) and all(tokens.decode(ids[d]) == (t or "").encode() for d, t in texts.items())
    assert {r["doc_id"] for r in queries.p9_found(spark, DATA).collect()} == {d for d, i in ids.items() if len(i) > 2048}
    assert all(r["same"] for r in queries.p8_round_trip(spark, DATA).collect())
    packed = queries.p9_packed(spark, DATA).collect()
    fill = queries.p9_fill(spark, DATA).first()
    assert fill["tokens"] == sum(map(len, ids.values())) and 0.9 < fill["fill"] <= 1
    assert sum(r["tokens"] for r in packed) == sum(map(len, ids.values())) and {r["doc_id"] for r in packed} == set(ids)


def test_sample_meets_quotas(spark):
    drawn = queries.p1_sample(spark, DATA)
    assert drawn.count() == drawn.select("item_id").distinct().count() > 0
    records, bank, targets = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("records", "question_bank", "sample_targets"))
    quotas = quota_sample.quotas(quota_sample.usable_items(records, bank), targets)
    want = {tuple(r[f"as_{c}"] for c in quota_sample.CATEGORY): r["quota"] for r in quotas.where("quota > 0").collect()}
    assert {tuple(r[c] for c in quota_sample.CATEGORY): r["count"] for r in drawn.groupBy(*quota_sample.CATEGORY).count().collect()} == want


def test_percentiles_are_within_the_bound(spark):
    got = queries.p2_percentiles(spark, DATA).collect()
    exact = connection().sql(f"WITH latest AS ({sql._LATEST}), r AS (SELECT {sql._word('model')} AS m, severity AS s, margin FROM latest WHERE {sql._USABLE}) SELECT m, s, list(margin ORDER BY margin) FROM r GROUP BY 1, 2").fetchall()
    lists = {(m, s): v for m, s, v in exact}
    assert len(got) == 4 * len(lists)
    for r in got:
        v = lists[r["model"], r["severity"]]
        slack = r["value"] * 2 * r["value_error"] + 1e-6
        assert r["n"] == len(v)
        assert sum(x <= r["value"] for x in v) + r["rank_error"] >= r["q"] * len(v) - 1 and sum(x < r["value"] - slack for x in v) - r["rank_error"] <= r["q"] * len(v) + 1


def test_groups_stay_together(spark):
    placed = queries.p3_assignment(spark, DATA)
    assert placed.where("group_id is not null").groupBy("group_id").count().where("count > 1").isEmpty()
    assert placed.groupBy("component").agg({"split": "count"}).count() == placed.select("component").distinct().count()
