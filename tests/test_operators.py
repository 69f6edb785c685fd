"""Core operators on small frames: contracts, brute force, nulls, ties and empty tables."""

import datetime as dt
import math
import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveworks.functions import normal, scalars
from sieveworks.operators import bank, blockcopy, components, grouping, hamming, inventory, pools, ranks, records, scoring
from sieveworks.plans import curation, small_files
from sieveworks.sources import shards, thrift


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, col, **values):
    kinds = {str: "string", int: "bigint", float: "double", type(None): "string", bool: "boolean"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


# spellings
@pytest.mark.parametrize("raw, want", [(" Est-Train ", "esttrain"), ("EST_TRAIN", "esttrain"), ("est train", "esttrain"), ("C-1", "c1"), ("NaN ", None), ("none", None), ("", None), ("  ", None), (None, None), ("endolume_1.5_4b_it", "endolume1.54bit")])
def test_word(spark, raw, want):
    assert one(spark, normal.word("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [("./a/b.jpg", "a/b.jpg"), (" a\\b c\\d.JPG ", "a/b c/d.JPG"), ("././x", "x"), (".hidden", ".hidden"), (None, None)])
def test_path(spark, raw, want):
    assert one(spark, normal.path("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [("ffffffffffffffff", -1), ("0xFFFFFFFFFFFFFFFE", -2), (" 0F ", 15), ("0000000000000000", None), ("", None), ("xyz", None), ("1" * 17, None), (None, None)])
def test_code(spark, raw, want):
    assert one(spark, normal.code64("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [("77", 77), ("g77", 77), ("G-77", 77), ("77.0", 77), ("0000000077", 77), ("grp_77 ", 77), ("x", None), (None, None), ("9" * 60, None)])
def test_group_number(spark, raw, want):
    assert one(spark, normal.group_number("a"), a=raw) == want


def test_latest_rows(spark):
    t = [dt.datetime(2026, 1, d) for d in (1, 2)]
    df = spark.createDataFrame([("a", t[0], 1), ("a", t[1], 2), ("a", t[1], 2), ("b", None, 3), (None, t[1], 4)], "k string, t timestamp, v int")
    assert rows(normal.latest_rows(df, "k", "t", ["v"])) == [("a", 2), ("b", 3)]
    assert rows(normal.latest_rows(df.limit(0), "k", "t", ["v"])) == []


# scalars
def test_scalars(spark):
    assert one(spark, scalars.stem(F.lit("a/b/c.tar.gz"))) == "c.tar"
    assert one(spark, scalars.classify(F.lit("X/KVASIR-SEG/masks/images/a.jpg"))) == "kvasir-seg-masks"
    assert one(spark, scalars.classify(F.lit("other/a.jpg"))) == "unclassified"
    assert one(spark, scalars.keyed_id(F.lit("a"), F.lit(None).cast("string"), F.lit(3))) == __import__("hashlib").sha256(b"a||3").hexdigest()[:16]
    assert scalars.config_hash({"b": 1, "a": 2}) == scalars.config_hash({"a": 2, "b": 1})
    assert scalars.git_revision("/") == "unknown"
    lp = one(spark, scalars.log_softmax(F.array(*[F.lit(float(v)) for v in (1, 2, 700)])))
    assert abs(sum(map(math.exp, lp)) - 1) < 1e-9
    m = one(spark, scalars.log_softmax_map(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(1.0))))
    assert m["a"] == pytest.approx(math.log(0.5))
    best, margin = scalars.argmax_margin(F.array(F.lit(2.0), F.lit(2.0), F.lit(1.0)))
    assert (one(spark, best), one(spark, margin)) == (0, 0.0)
    assert one(spark, scalars.argmax_margin(F.array(F.lit(2.0)))[1]) == math.inf
    opts = F.array(*[F.lit(x) for x in "wxyz"])
    a, b = one(spark, scalars.shuffled_options(F.lit("q"), opts)), one(spark, scalars.shuffled_options(F.lit("r"), opts))
    assert sorted(a) == sorted(b) == list("wxyz") and a == one(spark, scalars.shuffled_options(F.lit("q"), opts))
    assert one(spark, scalars.build_prompt(F.lit("Q?"), F.array(F.lit("u"), F.lit("v")))).endswith("\n\nQuestion: Q?\n\nA) u\nB) v\n\nAnswer:")
    assert one(spark, scalars.other_options(opts, F.lit("x"))) == ["w", "y", "z"]
    assert [one(spark, scalars.count_bucket(F.lit(n))) for n in (0, 1, 5)] == ["0", "1", "2 or more"]
    assert [one(spark, scalars.tertile(F.lit(v), F.lit(1.0), F.lit(2.0))) for v in (1.0, 1.5, 3.0)] == ["small", "mid", "large"]
    assert one(spark, scalars.resolved_class(F.lit(" NaN "), F.lit("polyp"))) == "polyps"


# Hamming joins
@pytest.mark.parametrize("t", [0, 2, 4, 6, 8, 10, 12])
def test_near_pairs_equal_brute_force(spark, t):
    r = random.Random(t)
    base = [r.getrandbits(64) for _ in range(30)]
    codes = []
    for i in range(150):
        c = base[i % 30]
        for b in r.sample(range(64), r.randrange(14)):
            c ^= 1 << b
        codes.append((f"f{i:03d}", c - (1 << 64) if c >= 1 << 63 else c, r.getrandbits(63)))
    df = spark.createDataFrame([*codes, ("null", None, 1)], "id string, ph bigint, dh bigint")
    classes = hamming.code_classes(df, "id", ["ph"])
    got = {(x["a"], x["b"], x["dist"]) for x in hamming.near_classes(classes, t).collect()}
    reps = {}
    for i, c, _ in codes:
        reps.setdefault(c, i)
    u = lambda c: c & (1 << 64) - 1
    pairs = [(i, j, bin(u(a) ^ u(b)).count("1")) for a, i in reps.items() for b, j in reps.items() if i < j]
    assert got == {p for p in pairs if p[2] <= t}


def test_dual_codes(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 3, (1 << 20) - 1), ("c", 3, 5), ("d", 1, 1)], "id string, ph bigint, dh bigint")
    dual = hamming.near_classes(hamming.code_classes(df, "id", ["ph", "dh"]), 4, "ph", "dh")
    assert rows(dual) == [("a", "c", 2, 1, 1)]
    assert rows(dual.limit(0)) == []


# components
@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_components_equal_union_find(spark, pairs):
    parent = list(range(41))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    v = spark.range(41)
    e = spark.createDataFrame([*pairs, (None, 1)], "a bigint, b bigint")
    assert rows(components.components(v, e)) == [(i, find(i)) for i in range(41)]


def test_group_map(spark):
    hx = lambda n: f"{n:016x}"
    inv = spark.createDataFrame(
        [("a", "d", None, "01", hx(255), hx(7)), ("b", "d", None, None, hx(254), hx(7)), ("c", "d", "x", None, hx(248), hx(15)), ("d", "d", None, "02", hx(7 << 40), hx(9)), ("e", "e", None, " 01", hx(1 << 50), hx(1)), ("m", "d", None, "01", None, None)],
        "rel_path string, dataset string, class_label string, sha256 string, phash string, dhash string",
    )
    g = grouping.group_map(inv, 2)
    assert dict((r["rel_path"], r["group"]) for r in g.collect()) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "a"}
    p = grouping.profile(g).first()
    assert (p["images"], p["groups"], p["singletons"], p["multi"], p["in_multi"], p["largest"]) == (5, 2, 1, 1, 4, 4)


def test_scan_without_hash_hides_no_file(spark):
    hx = lambda n: f"{n:016x}"
    inv = spark.createDataFrame(
        [("a", "d", None, "01", None, hx(7)), ("a", "d", None, None, hx(255), hx(7)), ("b", "d", None, "02", hx(254), hx(7)), ("b", "d", None, "02", hx(0), hx(7)), ("c", "d", None, "01", hx(1 << 50), hx(1)), ("d", "d", None, "01", None, None)],
        "rel_path string, dataset string, class_label string, sha256 string, phash string, dhash string",
    )
    assert rows(grouping.hashed_files(inv).select("rel_path", "sha", "ph", "dh")) == [("a", "01", 255, 7), ("b", "02", 254, 7), ("c", "01", 1 << 50, 1)]
    assert dict((r["rel_path"], r["group"]) for r in grouping.group_map(inv).collect()) == {"a": "a", "b": "a", "c": "a"}


def test_near_copies_share_a_group_and_split(spark, tmp_path):
    hx = lambda n: f"{n:016x}"
    far = lambda i: hx((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    files = [(f"i/cecum/{c}{i:02d}.jpg", "hyper", "cecum", f"{i:02x}{j}", True, hx(int(far(i), 16) ^ (j << j)), far(i + 50)) for i in range(20) for j, c in enumerate("ab")]
    files += [("i/cecum/z.jpg", "hyper", "cecum", "000", True, None, None), ("i/cecum/y.jpg", "hyper", "cecum", None, True, None, None), ("i/masks/m.png", "x-masks", None, None, True, None, None)]
    inv = spark.createDataFrame(files, "rel_path string, dataset string, class_label string, sha256 string, readable boolean, phash string, dhash string")
    d = str(tmp_path)
    inv.withColumn("mask_area_frac", F.lit(0.5)).write.parquet(f"{d}/inventory.parquet")
    group = {r["rel_path"]: r["group"] for r in curation.usable_rows(spark, d).collect()}
    assert all(group[f"i/cecum/a{i:02d}.jpg"] == group[f"i/cecum/b{i:02d}.jpg"] == f"{i:02x}0" for i in range(20))
    assert group["i/cecum/z.jpg"] == "000" and group["i/cecum/y.jpg"] == "i/cecum/y.jpg"
    assert curation.stratified_split(spark, d).count() == curation.canonical_row(spark, d).count() == len(set(group.values())) == 21
    assert tuple(curation.split_invariants(spark, d).first()) == (0, 0, 0)


# ranks
@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0], [5.0], [1.0] * 50 + [2.0] * 49, [float(i * i % 101) for i in range(500)]])
def test_percentiles(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    r = ranks.percentiles(df, "v", [0, 0.25, 1 / 3, 0.5, 1])
    assert list(r.first())[1:] == pytest.approx(list(np.quantile(values, [0, 0.25, 1 / 3, 0.5, 1])))
    assert list(ranks.percentiles(df.limit(0), "v", [0.5]).first()) == [0, None]


def test_split_sizes(spark):
    data = [(f"k{s}{i}", f"s{s}") for s in (1, 2, 10, 30) for i in range(s)] + [("n", None)]
    out = pools.stratified_split(spark.createDataFrame(data, "k string, s string"), "k", "s")
    got = {}
    for r in out.collect():
        got.setdefault(r["s"], {}).setdefault(r["split"], 0)
        got[r["s"]][r["split"]] += 1
    names = ["train", "est_train", "cal", "test"]
    assert {s: [got[s].get(n, 0) for n in names] for s in ("s1", "s2", "s10", "s30")} == {"s1": [0, 1, 0, 0], "s2": [0, 1, 1, 0], "s10": [2, 4, 2, 2], "s30": [8, 8, 6, 8]}
    assert got[None] == {"est_train": 1}


# pools
def test_group_pools(spark):
    r = lambda g, p, e, n=1: [(g, p, e)] * n
    df = spark.createDataFrame(r("a", "dyed", True, 3) + r("a", "upper_gi", False) + r("b", "upper_gi", False, 5) + r("b", "polyp", False) + r("c", "dyed", True, 2) + r("c", "too_few", True) + r("d", "unassigned", False), '"group" string, pool string, excluded boolean'.replace('"', "`"))
    got = {x["group"]: (x["pool"], x["excluded"], x["dropped"]) for x in pools.group_pools(df).collect()}
    assert got == {"a": ("upper_gi", False, 3), "b": ("polyp", False, 0), "c": ("dyed", True, 0), "d": ("unassigned", False, 0)}


def test_checked_write(spark, tmp_path):
    from sieveworks.sources import sinks

    df = spark.range(3)
    with pytest.raises(ValueError, match="bad"):
        sinks.write_checked(df, str(tmp_path / "x"), spark.createDataFrame([(1, 0)], "bad int, good int"))
    assert not (tmp_path / "x").exists()
    sinks.write_checked(df, str(tmp_path / "x"), spark.createDataFrame([(0,)], "bad int"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 3


# bank
def test_even_sample_has_no_top_up(spark):
    df = spark.createDataFrame([(f"{s}{i}", s, "t", 150) for s in ("a", "b", "c", "d") for i in range(60)] + [(f"x{i}", "a" if i < 5 else "b", "u", 40) for i in range(105)] + [(f"y{i}", "a", "v", None) for i in range(9)], "k string, split string, t string, budget int")
    got = dict(rows(bank.even_sample(df, ["t"], "k", "budget").groupBy("t").count()))
    assert got == {"t": 148, "u": 25, "v": 9}


def test_bank_checks(spark):
    ok = ("1", "A", ["x", "y"], ["y"], "x", True, "")
    data = [ok, ok, ("2", "B", ["x"], ["z"], "z", True, "1"), ("3", "D", ["x"], [], "x", True, "9"), ("4", "C1", ["x"], [], "x", False, None)]
    df = spark.createDataFrame(data, "question_id string, question_type string, options array<string>, unsafe_options array<string>, expected_behaviour string, answerable boolean, paraphrase_of string")
    assert list(bank.checks(df).first()) == [1, 1, 1, 1, 1, 2]
    assert list(bank.checks(df.limit(0)).first()) == [0] * 6
    with pytest.raises(ValueError, match="no answer rule"):
        bank.template_table(spark, [("t", "A", "x", ["p"], ["o"], "guess", None, "m")])


# records
LABELS = [(True, False, None, None, True), (False, False, None, None, False), (True, True, None, False, True), (True, True, None, True, False), (True, True, True, True, True), (True, True, False, None, False), (False, True, True, False, False), (None, None, None, None, False)]


def test_unsafe(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(LABELS)], "i int, gave_definite_answer boolean, answerable boolean, premise_accepted boolean, correct boolean, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(records.unsafe().alias("got"), "want").collect())


def _record(**over):
    r = {"image_id": "i", "question_id": "q", "condition": "clean", "severity": 0, "model": "m", "question_type": "A", "mechanism_label": "answer", "answerable": True, "correct": True, "premise_accepted": None, "options": ["x", "y"], "chosen_option": "x", "option_logprobs": {"x": -0.1, "y": -2.0}, "model_revision": "abc", "item_id": None} | over
    r["item_id"] = r["item_id"] or __import__("hashlib").sha256("|".join(str(r[c]) for c in ("image_id", "question_id", "condition", "severity", "model")).encode()).hexdigest()[:16]
    return r


@pytest.mark.parametrize("over, want", [({}, []), ({"condition": "jpeg", "severity": 0}, ["severity_0_not_clean"]), ({"severity": 2}, ["clean_with_severity"]), ({"model_revision": "main"}, ["revision_not_pinned"]), ({"answerable": False}, ["unanswerable_correct"]), ({"question_type": "C1"}, ["premise_missing"]), ({"premise_accepted": True}, ["premise_unexpected"]), ({"question_type": "D"}, ["d_without_evidence"]), ({"chosen_option": "z"}, ["choice_not_offered"]), ({"option_logprobs": {"x": 0.0}}, ["logprobs_incomplete"]), ({"item_id": "bad"}, ["item_id"]), ({"question_type": None, "mechanism_label": None, "condition": None, "severity": 9}, ["question_type", "mechanism_label", "condition", "severity_range", "item_id"]), ({"options": None, "option_logprobs": None, "chosen_option": None}, [])])
def test_validate(spark, over, want):
    r = _record(**over)
    schema = "image_id string, question_id string, condition string, severity int, model string, question_type string, mechanism_label string, answerable boolean, correct boolean, premise_accepted boolean, options array<string>, chosen_option string, option_logprobs map<string,double>, model_revision string, item_id string"
    assert spark.createDataFrame([tuple(r.values())], schema).select(records.problems().alias("p")).first()["p"] == want


# scoring
def _content(prompt, letters):
    lines = {x[0]: x[3:] for x in prompt.split("\n") if x[1:3] == ") "}
    return [2.0 if lines[c] == "yes" else -1.0 for c in letters]


def _letter_biased(prompt, letters):
    return [3.0 if c == "A" else -1.0 for c in letters]


def test_scoring(spark):
    items = spark.createDataFrame([(f"q{i}", "Is it?", ["yes", "no", "maybe"]) for i in range(6)], "question_id string, question_text string, options array<string>")
    runs = [scoring.score_items(items, _content, k) for k in range(4)]
    assert all(r["chosen"] == "yes" and abs(sum(map(math.exp, r["logprobs"].values())) - 1) < 1e-9 for run in runs for r in run.collect())
    flips = [scoring.score_items(items, _letter_biased, k).select("question_id", F.col("chosen").alias("chosen_option")) for k in range(6)]
    u = flips[0]
    for f in flips[1:]:
        u = u.unionByName(f)
    assert scoring.flip_rate(u.withColumn("m", F.lit("m")), ["question_id"], ["m"]).first()["flip_rate"] > 0.5
    many = items.withColumn("options", F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("string")))
    with pytest.raises(Exception, match="more than 8"):
        scoring.score_items(many, _content).collect()
    gate = {r["check"]: r["passed"] for r in scoring.probe_gate(spark, 0.0, 0.3, 0.6, 0.4).collect()}
    assert gate == {"determinism": True, "flips": False, "accuracy": True}
    assert scoring.gpu_hours(1.0) == 100.0
    full = scoring.score_items(items, _content, 0, lambda p, t: (-2.0 * len(t), len(t))).first()
    assert set(full["fulltext"].values()) == {-2.0} and scoring.score_items(items, _content).first()["fulltext"] is None
    import hashlib

    import numpy as np

    exact = scoring.score_items(items, _content, None).first()
    seed = int(hashlib.sha256(exact["question_id"].encode()).hexdigest()[:8], 16)
    options = items.where(F.col("question_id") == exact["question_id"]).first()["options"]
    assert exact["shown"] == [options[k] for k in np.random.default_rng(seed).permutation(len(options))]
    assert rows(scoring.flip_rate(scoring.reordered(items, _content).withColumn("m", F.lit("m")), ["question_id"], ["m"]).select("flip_rate")) == [(0.0,)]
    assert scoring.letter_ids(lambda c: [ord(c), 0], 3) == [65, 66, 67]
    with pytest.raises(ValueError, match="told apart"):
        scoring.letter_ids(lambda c: [1], 2)


def test_probe_subset(spark):
    data = [(f"q{i}", "presence" if i % 2 else "count", "A", "train" if i % 3 else "test") for i in range(60)] * 2
    items = spark.createDataFrame(data, "question_id string, template_id string, question_type string, split string")
    want = {q for q, t, _, s in data if t == "presence" and s == "train"}
    assert {r["question_id"] for r in scoring.probe_subset(items).collect()} == want and len(want) == 20
    few = [r["question_id"] for r in scoring.probe_subset(items, 7).collect()]
    assert len(set(few)) == 7 and few == [r["question_id"] for r in scoring.probe_subset(items.repartition(5), 7).collect()]
    assert scoring.probe_subset(items.limit(0)).count() == 0


def test_class_answers_are_exact(spark):
    cols = "rel_path string, class_label string, pool string, source string, options array<string>, components int, region string"
    opts = ["polyp", "normal mucosa", "ulcerative colitis", "haemorrhoids"]
    df = spark.createDataFrame([(c, c, "colonic_negative", "class", opts, None, None) for c in ("cecum", "cecum-x", "polyps-y", "ulcerative-colitis-grade-2", "ulcerative-colitis")], cols)
    assert {r["rel_path"]: r["expected"] for r in bank.answered(df).collect()} == {"cecum": "normal mucosa", "ulcerative-colitis-grade-2": "ulcerative colitis"}


def test_keys_grow_with_the_codes():
    assert [hamming.bands_to_agree(n, 4) for n in (0, 1 << 23, (1 << 23) + 1, 1 << 28, 1 << 30, 1 << 40)] == [2, 2, 3, 3, 4, 4] and hamming.bands_to_agree(1 << 40, 12) == 1
    r = random.Random(0)
    for agree in (2, 3, 4):
        masks = hamming.band_masks(4, agree)
        for _ in range(200):
            diff = sum(1 << b for b in r.sample(range(64), 4))
            assert any(diff & (m % (1 << 64)) == 0 for m in masks)


# small files
def test_shard_lines(spark):
    payload = '﻿# scan of 3\r\nrel_path,run,bytes\n"./a/b.jpg",1,10\n\na\\b.jpg\t2\t20\rbytes=5;run=3;rel_path= a/b.jpg;\n{"rel_path": "a\\/b.jpg", "run": 4, "bytes": 7}\n{"run":5,"bytes":9,"ok":true,"rel_path":"a/b.jpg"}\n{"rel_path": "a/b.jpg", "run": 6, "by\nbytes=5;run=7;rel_path=a/b.jpg\n"a/""q"".jpg",8,1\n"a/b.jpg",9,\n{"rel_path": "a/b.jpg", "run": 10}\n"a/b.jpg",11,4'
    df = spark.createDataFrame([("s", payload), ("t", None), ("u", "")], "shard_path string, payload string").withColumn("bytes", F.lit(1))
    assert rows(shards.scan_lines(df)) == [('a/"q".jpg', 8, 1), *[("a/b.jpg", r, b) for r, b in ((1, 10), (2, 20), (3, 5), (4, 7), (5, 9), (11, 4))]]
    assert shards.scan_records(df.unionByName(df)).count() == 7
    assert shards.scan_records(df.limit(0)).count() == 0


def test_small_files_become_few(spark, tmp_path, monkeypatch):
    lines = [f'"a/f{i}.jpg",{i % 3},{i}' for i in range(400)]
    tiny = spark.createDataFrame([(f"s{i}", 0, "\n".join(lines[i : i + 4] + lines[i : i + 1])) for i in range(0, 400, 4)], "shard_path string, n_bytes long, payload string")
    tiny.write.parquet(str(tmp_path / "raw_shards.parquet"))
    monkeypatch.setattr(small_files, "PIECE_ROWS", 10)
    made = small_files.p5_files(spark, str(tmp_path)).first()
    assert (made["tiny_files"], made["rows"], made["merged_files"]) == (100, 400, 1) and made["pieces"] >= 40
    assert small_files.p5_found(spark, str(tmp_path)).distinct().count() == 400


def test_block_copy(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.range(5_000).select("id", F.concat(F.lit("text "), (F.col("id") % 97).cast("string")).alias("s"), F.when(F.col("id") % 3 == 0, F.col("id") / 7).alias("d"), F.array("id").alias("a"))
    df.repartition(23).write.parquet(src)
    df.limit(10).select("id").repartition(2).write.parquet(src + "/other")
    made = blockcopy.consolidate(spark, src, str(tmp_path / "out"), 40_000).collect()
    assert sum(r["files"] for r in made) == 25 and sum(r["rows"] for r in made) == 5_010 and 2 <= len(made) < 10
    for r in made:
        meta = pq.ParquetFile(r["out"]).metadata
        assert meta.num_row_groups == r["blocks"] and meta.num_rows == r["rows"]
    wide = [r["out"] for r in made if "s" in pq.read_schema(r["out"]).names]
    back = spark.read.parquet(*wide)
    assert back.count() == 5_000 and back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert back.where("id = 4321 and s = 'text 53'").count() == 1
    (tmp_path / "src" / "broken.parquet").write_bytes(b"PAR1 no parquet")
    with pytest.raises(Exception, match="not a parquet file"):
        blockcopy.consolidate(spark, src, str(tmp_path / "out2")).collect()
    (tmp_path / "empty").mkdir()
    assert blockcopy.consolidate(spark, str(tmp_path / "empty"), str(tmp_path / "out3")).count() == 0


def _pieces(spark, folder):
    """Ten files of a hundred rows in all, by name."""
    spark.range(100).repartition(10).write.parquet(str(folder))
    return sorted(folder.glob("*.parquet"))


def _miscounted(file):
    """The file with a footer that says one row more than its blocks hold."""
    footer, body = blockcopy.read_footer(str(file))
    raw = thrift.dump_struct({**footer, 3: (thrift.I64, footer[3][1] + 1)})
    file.write_bytes(file.read_bytes()[:body] + raw + len(raw).to_bytes(4, "little") + blockcopy.MAGIC)


def test_block_copy_of_a_source_that_cannot_be_listed(spark, tmp_path):
    for source in ("nosuch://host/folder", str(tmp_path / "missing")):
        with pytest.raises(Exception, match="nosuch|PATH_NOT_FOUND"):
            blockcopy.consolidate(spark, source, str(tmp_path / "out")).collect()
    assert not (tmp_path / "out").exists()


def test_block_copy_between_folders_with_odd_names(spark, tmp_path):
    _pieces(spark, tmp_path / "a b%20c")
    made = blockcopy.consolidate(spark, str(tmp_path / "a b%20c"), str(tmp_path / "d e%20f")).first()
    assert (made["files"], made["rows"], made["blocks"]) == (10, 100, pq.ParquetFile(made["out"]).metadata.num_row_groups)


def test_block_copy_leaves_out_no_file(spark, tmp_path):
    files = _pieces(spark, tmp_path / "src")
    files[0].rename(tmp_path / "src" / "part-0.PARQ")
    files[1].rename(tmp_path / "src" / "000001_0")
    made = blockcopy.consolidate(spark, str(tmp_path / "src"), str(tmp_path / "out")).collect()
    assert [(r["files"], r["rows"]) for r in made] == [(10, 100)]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(100))
    files[2].write_bytes(b"")
    with pytest.raises(ValueError, match="1 of 10 files are empty"):
        blockcopy.consolidate(spark, str(tmp_path / "src"), str(tmp_path / "out2"))


def test_block_copy_that_fails_leaves_nothing(spark, tmp_path):
    files = _pieces(spark, tmp_path / "src")
    whole = files[-1].read_bytes()
    _miscounted(files[-1])
    with pytest.raises(Exception, match="its blocks hold"):
        blockcopy.consolidate(spark, str(tmp_path / "src"), str(tmp_path / "out"), 1).collect()
    assert [p.name for p in tmp_path.iterdir()] == ["src"]
    files[-1].write_bytes(whole)
    assert blockcopy.consolidate(spark, str(tmp_path / "src"), str(tmp_path / "out"), 1).count() == 10
    assert len(list((tmp_path / "out").iterdir())) == 10 and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(FileExistsError):
        blockcopy.consolidate(spark, str(tmp_path / "src"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_merged_file_is_whole_or_absent(spark, tmp_path, monkeypatch):
    files = [str(f) for f in _pieces(spark, tmp_path / "src")]
    (tmp_path / "out").mkdir()
    with monkeypatch.context() as m:
        m.setattr(pq, "ParquetFile", lambda f: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            blockcopy.merge_files(files, str(tmp_path / "out" / "a.parquet"))
    assert not list((tmp_path / "out").iterdir())
    assert blockcopy.merge_files(files, str(tmp_path / "out" / "a.parquet")) == (10, 100)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.parquet"]


def test_pieces_are_no_merged_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("s", 0, '"a/b.jpg",1,2')], "shard_path string, n_bytes long, payload string").write.parquet(str(tmp_path / "raw_shards.parquet"))
    monkeypatch.setattr(small_files, "consolidate", lambda spark, *a: spark.createDataFrame([], "bin bigint, files int, blocks int, rows bigint, out string"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        small_files.p5_found(spark, str(tmp_path)).collect()


def test_thrift_round_trip():
    s = {1: (thrift.I32, -5), 2: (thrift.LIST, (thrift.STRUCT, [{1: (thrift.TRUE, True), 40: (thrift.BINARY, b"x" * 300)}] * 20)), 3: (thrift.I64, 1 << 60), 4: (thrift.FALSE, False), 5: (thrift.DOUBLE, 2.5), 6: (thrift.LIST, (thrift.TRUE, [True, False])), 7: (thrift.MAP, (thrift.BINARY << 4 | thrift.I32, [(b"k", 3)])), 8: (thrift.BYTE, 7)}
    raw = thrift.dump_struct(s)
    assert thrift.dump_struct(thrift.Reader(raw).struct()) == raw


def test_inventory_pairs(spark):
    df = spark.createDataFrame([("kvasir-seg/images/a.jpg", "kvasir-seg-images", 4, 4), ("kvasir-seg/masks/a.png", "kvasir-seg-masks", 4, 5), ("kvasir-seg/images/b.jpg", "kvasir-seg-images", 1, 1), ("kvasir-seg/masks/c.jpg", "kvasir-seg-masks", 1, 1)], "rel_path string, dataset string, width int, height int")
    assert rows(inventory.unpaired(df)) == [("image", "b"), ("mask", "c")]
    assert rows(inventory.mismatched(df)) == [("a", 4, 4, 4, 5)]
    assert rows(inventory.find_masks(df.select("rel_path"), df)) == []
