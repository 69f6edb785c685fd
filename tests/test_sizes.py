"""What the planner may broadcast: no rows that were multiplied after their size was known."""

import numpy as np
import pytest

from sieveworks.operators import bank, grouping, hamming, pools
from sieveworks.plans import catalogue
from tests.compare import DATA


def broadcasts_of_keys(df):
    """Lines of the plan in which rows multiplied by the masks of a Hamming join are broadcast."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = next((i for i, c in enumerate(line) if c.isalnum() or c in "*("), 0)
        if depth is not None and at <= depth:
            depth = None
        if "BroadcastExchange" in line and depth is None:
            depth = at
        if depth is not None and "Generate" in line and "pool" not in line:
            found.append(line)
    return found


@pytest.fixture
def plans(spark, monkeypatch):
    """The broadcasts found in every table that is cut off, under Spark's own limit for broadcasts."""
    seen, kind = [], type(spark.range(1))
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, eager=True: (seen.extend(broadcasts_of_keys(df)), checkpoint(df, eager))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield seen
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


QUERIES = [
    "near_dup_pairs", "dual_hash_pairs", "components", "stratified_split", "question_items", "built_checks", "exclude_laundered", "group_profile", "mask_coverage", "pool_conflicts",
    "split_invariants", "usable_rows", "canonical_row", "majority_pool", "split_images", "class_collapse", "group_examples", "pool_histogram", "split_pivot", "cross_within_pairs",
    "group_sizes", "tertile_bins", "threshold_sweep",
]


@pytest.mark.parametrize("name", QUERIES)
def test_keys_are_not_broadcast(spark, plans, name):
    assert plans + broadcasts_of_keys(catalogue.queries()[name](spark, DATA)) == []


def planted(threshold, n=300):
    """Distinct pairs of codes around a few of them, and the positions of those near in both codes."""
    r = np.random.default_rng(threshold)
    pick = r.integers(0, 15, n)
    codes = [r.integers(0, 1 << 64, 15, dtype=np.uint64)[pick] for _ in range(2)]
    for c in codes:
        for i in range(n):
            for b in r.choice(64, r.integers(0, threshold + 2), replace=False):
                c[i] ^= np.uint64(1) << np.uint64(b)
    rows = np.unique(np.stack(codes, 1), axis=0)
    near = [np.bitwise_count(c[:, None] ^ c[None, :]) <= threshold for c in rows.T]
    return rows.T.copy(), set(zip(*(x.tolist() for x in np.nonzero(np.triu(near[0] & near[1], 1))), strict=True))


@pytest.mark.parametrize("t", [0, 4, 12])
@pytest.mark.parametrize("crowd", [0, 1 << 20])
def test_dual_pairs_equal_brute_force(spark, t, crowd):
    (one, two), want = planted(t)
    at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(one.view(np.int64), two.view(np.int64), strict=True))}
    classes = spark.createDataFrame([(a, b) for a, b in at], "ph bigint, dh bigint")
    got = [tuple(sorted((at[x["a1"], x["a2"]], at[x["b1"], x["b2"]]))) for x in hamming.dual_pairs(classes, t, "ph", "dh", crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("agree", [0, 1, 2, 3])
def test_task_equals_brute_force_at_any_keys(monkeypatch, agree):
    monkeypatch.setattr(hamming, "cheapest_agree", lambda n, t: agree)
    monkeypatch.setattr(hamming, "SHORT", 4)
    (one, two), want = planted(4)
    row, mask = (x.ravel() for x in np.meshgrid(np.arange(len(one)), np.arange(5), indexing="ij"))
    i, j = hamming.near_in_task(one[row], two[row], mask, np.full(len(row), -1), 4)
    got = [tuple(sorted(x)) for x in zip(row[i].tolist(), row[j].tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_links_of_keys(spark):
    """Keys of copies and near copies are one group; files of one key are linked through it."""
    hx = lambda n: f"{n:016x}"
    inv = spark.createDataFrame(
        [("a", "d", None, None, hx(255), hx(7)), ("b", "d", None, None, hx(255), hx(7)), ("c", "d", None, None, hx(254), hx(7)), ("d", "d", None, None, hx(1 << 40), hx(9)), ("e", "d", None, None, None, None), ("x", "d", None, None, hx(253), hx(7))],
        "rel_path string, dataset string, class_label string, sha256 string, phash string, dhash string",
    )
    keys = spark.createDataFrame([("a", "k3"), ("b", "k2"), ("c", "k4"), ("d", "k1"), ("e", "k4")], "rel_path string, key string")
    got = {r["rel_path"]: r["group"] for r in grouping.linked_keys(inv, keys).collect()}
    assert got == {"a": "k2", "b": "k2", "c": "k2", "d": "k1", "e": "k2"}


def test_modes_count_only_mixed_groups(spark, monkeypatch):
    df = spark.createDataFrame([("g", "p", "b", "x"), ("g", "p", "a", "y"), ("h", "p", "c", "x"), ("h", "p", "d", "x"), ("h", "p", "a", "y"), ("i", "q", "e", "z")], "group string, pool string, rel_path string, class string")
    held, kept = [], pools.saved
    monkeypatch.setattr(pools, "saved", lambda df, name: held.append(df.count()) or kept(df, name))
    assert {r["group"]: r["class"] for r in pools._mode(df, "class").collect()} == {"g": "y", "h": "x", "i": "z"} and held == [2]


def test_sample_ranks_only_what_budgets_reach(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("'t' as t", "cast(id as string) as k", "if(id % 2 = 0, 'train', 'test') as split", "20 as budget")
    seen, rank = [], bank.hash_rank
    monkeypatch.setattr(bank, "hash_rank", lambda df, *a, **x: seen.append(df.count()) or rank(df, *a, **x))
    got = bank.even_sample(df, ["t"], "k", "budget")
    assert got.groupBy("split").count().collect() and {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 10, "test": 10}
    assert max(seen) < 200


def test_checks_keep_no_texts(spark, monkeypatch):
    seen, kind = [], type(spark.range(1))
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, eager=True: (seen.append(set(df.columns)), checkpoint(df, eager))[1])
    catalogue.queries()["built_checks"](spark, DATA)
    assert seen and not any(c & {"question_text", "unsafe_options"} for c in seen)


def test_sweep_links_all_thresholds_in_the_same_rounds(spark, monkeypatch):
    hx = lambda n: f"{n:016x}"
    chain = [(f"f{i:02d}", "d", None, f"{i // 2:02x}", hx(1 + (1 << 60) + sum(3 << 2 * k + 4 for k in range(i))), hx(7)) for i in range(12)]
    inv = spark.createDataFrame(chain, "rel_path string, dataset string, class_label string, sha256 string, phash string, dhash string")
    seen, kind = [], type(inv)
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, eager=True: (seen.append(1), checkpoint(df, eager))[1])
    got = {r["threshold"]: tuple(r)[1:] for r in grouping.threshold_sweep(inv, [4, 0, 1, 2, 12, 3]).collect()}
    assert got == {0: (0, 6, 6, 12, 2), 1: (0, 6, 6, 12, 2), 2: (11, 1, 1, 12, 12), 3: (11, 1, 1, 12, 12), 4: (21, 1, 1, 12, 12), 12: (51, 1, 1, 12, 12)}
    assert len(seen) < 25
