"""The training-data operators against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import cutoffs, group_split, match_groups, minhash, packing, quantile_digest, queries, quota_sample, selection, split_overlap, tokens, truncation


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# problem 1
def _bank(spark, data):
    return spark.createDataFrame(data, "question_id string, pool string, question_type string, extra string")


def _records(spark, data):
    return spark.createDataFrame(data, "item_id string, timestamp timestamp, split string, question_id string, pool string").withColumn("pool", F.lit("clash"))


def test_quota_sample(spark):
    import datetime as dt

    t = [dt.datetime(2026, 1, 1, h) for h in range(5)]
    recs = [(f"i{k}", t[0], "Train ", "q1" if k < 12 else "q2", None) for k in range(20)]
    recs += [("i0", t[1], "train", "q2", None), (None, t[0], "train", "q1", None), ("x", t[0], None, "q1", None), ("y", None, "TRAIN", "q9", None)]
    recs += [("i5", t[0], "Train ", "q1", None)]
    bank = _bank(spark, [("q1", "Polyp", "a", None), ("q1", None, "A", None), ("q2", "upper gi", "B", None), ("q3", "none", "B", None), (None, "polyp", "A", None)])
    targets = spark.createDataFrame([("train", "polyp", "A", 500, 500, 2), ("train", "upper_gi", "B", 500, 500, 30), ("cal", "polyp", "A", 500, 500, 1)], "split string, pool string, question_type string, sample_permille int, share_permille int, min_items bigint")
    records = _records(spark, recs)
    assert rows(quota_sample.shortfalls(records, bank, targets)) == [("cal", "polyp", "A"), ("train", "upper_gi", "B")]
    q = {r["pool"] + r["split"]: r for r in quota_sample.quotas(quota_sample.usable_items(records, bank), targets).collect()}
    assert (q["polyptrain"]["n"], q["polyptrain"]["available"], q["polyptrain"]["wanted"], q["polyptrain"]["quota"]) == (20, 11, 5, 5)
    assert (q["uppergitrain"]["available"], q["uppergitrain"]["wanted"], q["uppergitrain"]["quota"]) == (9, 30, 9)
    drawn = quota_sample.sample(records, bank, targets).collect()
    assert len(drawn) == 14 and len({r["item_id"] for r in drawn}) == 14
    none = records.limit(0)
    assert len(rows(quota_sample.shortfalls(none, bank.limit(0), targets))) == 3
    assert rows(quota_sample.sample(none, bank, targets)) == []


def test_largest_remainder(spark):
    items = spark.createDataFrame([(f"{p}{i}", "train", p, "a") for p, n in (("x", 10), ("y", 10), ("z", 10)) for i in range(n)], "item_id string, split string, pool string, question_type string")
    t = spark.createDataFrame([("train", p, "A", 333, s, 0) for p, s in (("x", 350), ("y", 350), ("z", 300))], "split string, pool string, question_type string, sample_permille int, share_permille int, min_items bigint")
    q = {r["pool"]: r["quota"] for r in quota_sample.quotas(items, t).collect()}
    assert q == {"x": 3, "y": 3, "z": 3}  # 3.50, 3.50 and 3.00 of 9.99: floors of 3, 3 and 2, and the largest remainder to z


def test_smallest_keys(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g")).withColumn("quota", F.when(F.col("g") == "a", 777).otherwise(5_000))
    got = selection.smallest_keys(df, "g", "id", "quota", 3)
    counts = dict(rows(got.groupBy("g").count()))
    assert counts == {"a": 777, "b": 2000}
    want = set(sorted(range(20_000), key=lambda i: hashlib.sha256(f"3|{i}".encode()).hexdigest() if i % 10 else "z")[:777])
    assert {r["id"] for r in got.where("g = 'a'").collect()} == want
    assert rows(selection.smallest_keys(df.withColumn("quota", F.lit(None).cast("int")), "g", "id", "quota")) == []


# problem 2
@pytest.mark.parametrize("values", [np.random.default_rng(1).exponential(2, 30_000), np.repeat([0.0, 1.5, 1e12], 9_000), np.arange(7.0)])
def test_digest_error_is_bounded(spark, values):
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)] + [(None, 0)], "v double, day int").withColumn("n", F.lit("clash")).withColumn("g", F.lit(None).cast("string"))
    merged = quantile_digest.merge(quantile_digest.digests(df, "v", ["g", "day"]), ["g"])
    got = quantile_digest.percentiles(merged, ["g"], [0.5, 0.9, 0.99]).collect()
    ordered = np.sort(values)
    for r in got:
        assert r["n"] == len(values)
        low, high = np.searchsorted(ordered, r["value"] * (1 - 2 * r["value_error"]) - 1e-6), np.searchsorted(ordered, r["value"] + 1e-9, side="right")
        rank = r["q"] * len(values)
        assert low - r["rank_error"] - 1 <= rank <= high + r["rank_error"] + 1
    assert rows(quantile_digest.digests(df.limit(0), "v", ["g"])) == []


def test_digest_is_small(spark):
    v = np.random.default_rng(2).lognormal(0, 2, 200_000)
    lv, nd, ct = quantile_digest.compress(np.zeros(len(v), np.int64), np.floor(np.log1p(v / quantile_digest.X0) / quantile_digest._STEP).astype(np.int64), np.ones(len(v), np.int64), 100)
    assert ct.sum() == len(v) and len(ct) < 3 * 100 * 2


# problem 3
def test_conflicts_and_groups(spark):
    recs = spark.createDataFrame([("a", "q", "train", "G-7"), ("b", "q", "Test", "0000000007"), ("c", "q", "cal", "8.0"), ("d", "q", "NaN", "grp_8 "), ("e", "q2", "cal", None), ("f", "q2", "test", "nonsense"), ("g", "q3", "cal", None), ("h", "q3", "test", None)], "item_id string, question_id string, split string, group_id string")
    bank = spark.createDataFrame([("q2", 9), ("q2", None), ("q", 1)], "question_id string, group_id bigint")
    assert rows(group_split.conflicts(group_split.record_groups(recs, bank))) == [(7,), (9,)]
    assert rows(group_split.conflicts(group_split.record_groups(recs.limit(0), bank))) == []


def test_divided_groups_come_from_the_assignment(spark, monkeypatch):
    recs = [("a", "q", "train", "G-7"), ("b", "q", "Test", "0000000007"), ("c", "q", "cal", "8.0"), ("d", "q", "NaN", "grp_8 "), ("e", "q2", "cal", None), ("f", "q2", "test", None), ("g", "q3", "cal", None), ("g", "q3", "test", None), ("a", "q", "train", "8")]
    bank = spark.createDataFrame([("q2", 9, "polyp"), ("q2", None, None), ("q", 1, "dyed")], "question_id string, group_id bigint, pool string")
    prop = spark.createDataFrame([("train", 0.5, 0), ("test", 0.5, 1)], "split string, proportion double, ord int")
    tables = {"records": spark.createDataFrame(recs, "item_id string, question_id string, split string, group_id string"), "question_bank": bank, "split_proportions": prop}
    monkeypatch.setattr(queries, "table", lambda _s, _d, name: tables[name])
    assigned, assign = [], group_split.assign
    monkeypatch.setattr(group_split, "assign", lambda *a: assigned.append(1) or assign(*a))
    assert rows(queries.p3_found(spark, "")) == [(7,), (8,), (9,)] and assigned
    placed = {r["group_id"]: r for r in queries.p3_assignment(spark, "").collect() if r["group_id"]}
    assert placed[7]["component"] == placed[8]["component"] and placed[7]["split"] == placed[8]["split"]
    tables["records"] = tables["records"].limit(0)
    assert rows(queries.p3_found(spark, "")) == []


def test_entity_components(spark):
    links = [("r1", "a"), ("r1", "b"), ("r2", "b"), ("r2", "c"), ("r3", "z"), (None, "y"), ("r4", None), ("r5", "x"), ("r5", "x")] + [(f"c{i}", f"e{j:02d}") for i in range(30) for j in (i, i + 1)]
    got = dict(rows(group_split.entity_components(spark.createDataFrame(links, "record string, entity string"))))
    assert got["a"] == got["b"] == got["c"] == "a" and got["z"] == "z" and got["y"] == "y" and got["x"] == "x"
    assert {got[f"e{j:02d}"] for j in range(31)} == {"e00"}


def test_assignment_keeps_components_and_shares(spark):
    r = random.Random(4)
    data = [(f"c{r.randrange(3000)}", r.choice(["p", "q", None])) for _ in range(20_000)] + [("hot", "p")] * 2_500
    df = spark.createDataFrame(data, "component string, label string")
    prop = spark.createDataFrame([("train", 0.25, 0), ("est_train", 0.3, 1), ("cal", 0.2, 2), ("test", 0.25, 3)], "split string, proportion double, ord int")
    placed = group_split.assign(df, prop)
    assert placed.groupBy("component").count().where("count > 1").isEmpty()
    sizes = dict(rows(df.join(placed, "component").groupBy("split").count()))
    assert all(abs(sizes[s] / len(data) - p) < 0.02 for s, p in (("train", 0.25), ("est_train", 0.3), ("cal", 0.2), ("test", 0.25)))
    by = {(x["split"], x["label"]): x["count"] for x in df.where("label is not null").join(placed, "component").groupBy("split", "label").count().collect()}
    for s in sizes:
        assert abs(by[s, "p"] / (by[s, "p"] + by[s, "q"]) - 0.59) < 0.08
    assert rows(group_split.assign(df.limit(0), prop)) == []


@pytest.mark.parametrize("upset", [0, 2])
def test_assignment_is_exact_at_every_size(spark, upset):
    """Classes of equal components are dealt in the very proportions; where large components upset the balance, the labels are balanced by the others."""
    prop = spark.createDataFrame([("train", 0.5, 0), ("cal", 0.25, 1), ("test", 0.25, 2), ("none", 0.0, 3)], "split string, proportion double, ord int")
    data = [(f"{kind}{i}", label, n) for kind, members, loads in (("s", 401, [("p", 1)]), ("m", 63, [("p", 2), ("q", 3)]), ("b", upset, [("q", 20)])) for i in range(members) for label, n in loads]
    placed = dict(rows(group_split.assign_counts(spark.createDataFrame(data, "component string, label string, n int"), prop)))
    assert len(placed) == 464 + upset
    for split, p in (("train", 0.5), ("cal", 0.25), ("test", 0.25)):
        for kind, members in (("s", 401), ("m", 63)) if not upset else ():
            assert abs(sum(c[0] == kind and s == split for c, s in placed.items()) - members * p) < 3
        for label in "pq":
            total = sum(n for _, x, n in data if x == label)
            assert abs(sum(n for c, x, n in data if x == label and placed[c] == split) - p * total) <= (0.04 if upset else 0.02) * total


def test_balance_reports_deviations(spark):
    recs = spark.createDataFrame([(f"i{i}", f"q{i % 7}", None, f"g{i // 3}") for i in range(300)], "item_id string, question_id string, split string, group_id string")
    bank = spark.createDataFrame([(f"q{i}", i, "polyp" if i % 2 else None) for i in range(7)], "question_id string, group_id bigint, pool string")
    prop = spark.createDataFrame([("train", 0.5, 0), ("test", 0.5, 1)], "split string, proportion double, ord int")
    got = {(r["split"], r["label"]): r for r in group_split.balance(recs, bank, prop).collect()}
    assert len(got) == 6 and sum(r["rows"] for k, r in got.items() if k[1] == "(all)") == 300
    assert all(abs(r["deviation"]) < 0.03 and abs(r["share"] - r["wanted"] - r["deviation"]) < 1e-12 for r in got.values())
    assert rows(group_split.balance(recs.limit(0), bank, prop)) == []


# problem 4
@pytest.mark.parametrize("per_task", [7, 10_000])
def test_linked_groups(spark, per_task):
    r = random.Random(per_task)
    pairs = [(f"n{r.randrange(300):03d}", f"n{r.randrange(300):03d}") for _ in range(150)] + [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(80)] + [("hub", f"z{i}") for i in range(60)]
    pairs += [("a", "a"), (None, "b"), ("c", None), ("k000", "k001"), ("k001", "k000")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((find(v), v) for v in parent)
    df = spark.createDataFrame([(*p, 1) for p in pairs], "a string, b string, group_id int").select("a", "b", "group_id")
    assert rows(match_groups.linked_groups(df, per_task)) == want
    assert rows(match_groups.linked_groups(df.limit(0), per_task)) == []


def test_levels_grow_as_the_logarithm(spark):
    n, progress = 20_000, []
    order = list(range(n))
    random.Random(8).shuffle(order)
    chain = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(-1, -2 - i) for i in range(3_000)], "a bigint, b bigint")
    got = match_groups.linked_groups(chain, 1_000, progress)
    assert rows(got.groupBy("group_id").count()) == [(-3_001, 3_001), (0, n)]
    assert len(progress) <= 8 and all(y < 0.62 * x for x, y in zip(progress[1:], progress[2:]))
    spread = match_groups.dealt(chain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), n + 2_999, 1_000, 0)
    assert spread.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0] < 3_500


# problem 6
def test_cutoffs(spark):
    r = random.Random(6)
    data = [("s", float(r.choice([1, 1, 2, 3.25, r.random()]))) for _ in range(3_000)] + [("t", 5.0)] * 50 + [("tiny", 1e-320), ("tiny", 5e-324), ("tiny", 0.0), (None, 1.0), ("s", None), ("other", 3.0)]
    df = spark.createDataFrame(data, "source string, score double")
    targets = spark.createDataFrame([("s", 333), ("t", 100), ("tiny", 400), ("none", 500), ("s", 900), (None, 1)], "source string, keep_permille int")
    got = {x["source"]: x for x in cutoffs.cutoffs(df, targets).collect()}
    s = sorted((v for k, v in data if k == "s" and v is not None), reverse=True)
    want = s[-(-len(s) * 333 // 1000) - 1]
    assert got["s"]["cutoff"] == want and got["s"]["kept"] == sum(v >= want for v in s) and got["s"]["n"] == len(s)
    assert (got["t"]["cutoff"], got["t"]["kept"]) == (5.0, 50)
    assert (got["tiny"]["cutoff"], got["tiny"]["kept"]) == (5e-324, 2)
    assert (got["none"]["cutoff"], got["none"]["kept"], got["none"]["n"]) == (None, 0, 0)
    assert cutoffs.kept_rows(df, cutoffs.cutoffs(df, targets)).where("source = 't'").count() == 50
    assert {x["kept"] for x in cutoffs.cutoffs(df.limit(0), targets).collect()} == {0}


# problem 7
def test_overlaps(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(40)]
    files = []
    for i in range(160):
        code = base[i % 40]
        for b in r.sample(range(64), r.randrange(7)):
            code ^= 1 << b
        spelled = r.choice(["{:016x}", "0x{:016X}", " {:016x}"]).format(code) if i % 9 else r.choice([None, "", "0" * 16])
        files.append((f"labeled-images/x/f{i:03d}.JPG", "d", r.choice([None, f"{i % 50:064x}", f" {i % 50:064X}"]), spelled, "extra"))
    files += [("kvasir-seg/masks/f000.png", "kvasir-seg-masks", f"{1:064x}", "ff", "x"), (None, "d", None, None, "x")]
    inv = spark.createDataFrame(files, "rel_path string, dataset string, sha256 string, phash string, split string").drop("split")
    splits = {i: r.choice(["Train", "est-train", "cal", "TEST", "none", None]) for i in range(150)}
    recs = spark.createDataFrame([(f"hyperkvasir/f{i:03d}", s) for i, s in splits.items()] + [(None, "cal")], "image_id string, split string")

    def value(h, zero):
        h = (h or "").strip().lower().removeprefix("0x")
        return int(h, 16) if h and (zero or int(h, 16)) else None

    side = {"Train": 0, "est-train": 0, "cal": 1, "TEST": 1}
    known = [(f, value(s, True), value(p, False), side[splits[i]]) for i, (f, _, s, p, _) in enumerate(files[:150]) if splits[i] in side]
    want = sorted({(min(a[0], b[0]), max(a[0], b[0])) for a in known for b in known if a[3] == 0 and b[3] == 1 and ((a[1] is not None and a[1] == b[1]) or (a[2] and b[2] and bin(a[2] ^ b[2]).count("1") <= 4))})
    fs = split_overlap.file_splits(inv, recs)
    pairs = split_overlap.overlaps(fs)
    assert rows(pairs.select("a", "b")) == want and len(want) > 20
    rep = split_overlap.report(fs, pairs).collect()
    assert sum(x["exact"] + x["near"] for x in rep) == len({p for w in want for p in w})
    assert rows(split_overlap.overlaps(fs.limit(0))) == []


def test_bands_are_min_hashes(spark):
    """The keys equal min-hashes of (position, bit) shingles by permutations that rank the positions of the band first, and no near pair is lost."""
    r = random.Random(9)
    masks = [m % (1 << 64) for m in split_overlap.band_masks(4, 2)]
    code = r.getrandbits(64)
    shingles = {(p, code >> p & 1) for p in range(64)}
    for m in masks:
        band = [p for p in range(64) if m >> p & 1]
        minima = []
        for first in band:
            ranks = {s: (s[0] != first, r.random()) for s in ((p, b) for p in range(64) for b in (0, 1))}
            minima.append(min(shingles, key=ranks.get))
        assert sum(b << p for p, b in minima) == code & m
    pairs = [(code, code ^ sum(1 << b for b in r.sample(range(64), d))) for d in (1, 2, 3, 4, 5, 6) for _ in range(30)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(b),) for _, b in pairs], "code bigint").distinct()
    got = split_overlap.near_codes(spark.createDataFrame([(signed(code),)], "code bigint"), df, 4)
    assert {b for _, b in rows(got)} == {signed(b) for a, b in pairs if bin(a ^ b).count("1") <= 4}


# problem 8
TEXTS = [None, "", " ", "plain words, and more.", "a\r\n\n\t b  ", "日本語のテキスト🙂", "<|endoftext|>", "é́​﻿", "x" * 3000, ("word " * 900 + "\n\n") * 3, "don't 1234 " * 500]


def test_tokens(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")
    got = dict((r["doc_id"], list(r["ids"])) for r in tokens.encoded(df).collect())
    for i, t in enumerate(TEXTS):
        assert got[i] == (other.encode(t, add_special_tokens=False).ids if t else [])
        assert tokens.encode(t, chunk=50) == got[i]
        assert tokens.decode(got[i]) == (t or "").encode()
    back = df.select("doc_id", tokens.text_of(tokens.token_ids(F.col("text"))).alias("b")).collect()
    assert all(bytes(r["b"]) == (TEXTS[r["doc_id"]] or "").encode() for r in back)
    assert tokens.encoded(df.limit(0)).count() == 0


# problem 9
def test_packing(spark):
    r = random.Random(9)
    data = [(i, r.choice([r.randrange(1, 60), 100, 0])) for i in range(4_000)] + [(4_000, 250), (4_001, 300), (4_002, None), (1, 5)]
    df = spark.createDataFrame(data, "id bigint, bin int").repartition(2)
    packed = packing.pack(df, "id", F.col("bin"), 100, 16)
    got = packed.collect()
    assert rows(packing.oversized(packed)) == [(4_000,), (4_001,)]
    assert sum(x["size"] for x in got) == sum(n or 0 for _, n in data)
    assert len({(x["id"], x["piece"]) for x in got if x["id"] != 1}) == len([x for x in got if x["id"] != 1])
    fill = packing.bin_fill(packed).collect()
    assert max(x["used"] for x in fill) <= 100
    assert sum(x["used"] for x in fill) / (100 * len(fill)) > 0.95
    assert [x["size"] for x in sorted((x for x in got if x["id"] == 4_000), key=lambda x: x["piece"])] == [100, 100, 50]
    assert all(x["bin"] is None for x in got if x["size"] == 0)
    assert packing.pack(df.limit(0), "id", F.col("bin"), 100).count() == 0


def test_packer_is_best_fit():
    p = packing.Packer(10, 2)
    assert [p.place(6), p.place(7), p.place(3), p.place(4), p.place(8), p.place(5), p.place(5)] == [0, 1, 1, 0, 2, 3, 3]


# problem 10
def test_truncation(spark):
    line = "In frame {} the view is spoiled by low light, so the first reader chose to wait."
    whole = [line.format(100 + i) + f" The mask {w} was kept." for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 20)]
    docs = [(i, t, "notes", "prose") for i, t in enumerate(whole)]
    docs += [(200 + i, t + "\n\nNight desk", "notes", "prose") for i, t in enumerate(whole[:10])]
    docs += [(300 + i, f"seed: {i}\nkinds: a\n# end of settings", "dump", "yaml") for i in range(20)]
    docs += [(400, line.format(7)[:-20], "notes", "prose"), (401, line.format(8) + " The ma�", "notes", "prose"), (402, "Q: why\nA: it is [cut]", "notes", "qa"), (403, "seed: 4\nkin", "dump", "yaml"), (404, "No end of note because the mar", None, None)]
    docs += [(500, None, "notes", "prose"), (501, "", "notes", "prose"), (502, " \n​", None, "prose"), (503, line.format(1) + " 🙂", "notes", "prose")]
    docs += [(600 + i, "agreed", "chat", "short") for i in range(5)]
    long = " ".join(line.format(n) for n in range(60))
    docs += [(700, long + " The crop was redrawn by hand, then rated.", "notes", "prose"), (701, long + " The crop was redrawn", "notes", "prose")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, doc_type string").withColumn("cut", F.lit(1)).withColumn("kind", F.lit(2))
    got = {r["doc_id"] for r in truncation.truncated(df).where("cut").collect()}
    assert got == {400, 401, 402, 403, 404, 701}
    by = {r["source"]: r for r in truncation.by_source(truncation.truncated(df)).collect()}
    assert by["dump"]["truncated"] == 1 and by["dump"]["documents"] == 21
    assert truncation.truncated(df.limit(0)).count() == 0


def test_remarks_are_whole_by_how_often_they_occur(spark):
    said = ["agreed", "same as before, keep", "問題はありません"]
    docs = [(i, said[i % 3]) for i in range(600)]
    docs += [(700, "same as before, ke"), (701, "第二評価者によれば病変は再確"), (702, "第二評価者によれば病変は再確認された。"), (703, "аgreed"), (704, "agreed 👍")]
    df = spark.createDataFrame([(i, t, "notes", "short") for i, t in docs], "doc_id bigint, text string, source string, doc_type string")
    assert rows(truncation.truncated(df).where("cut").select("doc_id")) == [(700,), (701,)]
    few = df.where("doc_id < 20 or doc_id = 701").unionByName(df.where("doc_id = 0").withColumn("text", F.lit("ok for me")))
    assert rows(truncation.truncated(few).where("cut").select("doc_id")) == [(701,)]


def test_near_copies_in_any_order(spark):
    r = random.Random(10)
    body = " ".join(f"word{r.randrange(900)}" for _ in range(80))
    docs = [(1, f"Dear Ann {body} shows the large polyp near the fold", "mail"), (2, f"Dear Tom {body} shows the lar", "mail")]
    docs += [(3, f"{body} first end of the sheet", "a"), (4, f"{body} first end", "a"), (5, f"{body} first end\nnext line", "a"), (6, f"{body} first end", "b")]
    docs += [(7, f"{body} was kept.", "a"), (8, f"{body} was kept. Then it was shown.", "a"), (9, None, None)]
    df = spark.createDataFrame(docs, "doc_id int, text string, doc_type string").withColumn("source", F.lit("s"))
    ends = truncation.closings(df)
    found = truncation.aligned(df, truncation.distinct_texts(ends), truncation.facts(df, np.zeros(1 << 10, bool), np.zeros(1 << 10, bool)))
    assert rows(ends.join(found, "h").select("doc_id")) == [(2,), (4,), (6,)]


def test_alignment_finds_cut_near_copies_that_are_no_prefixes(spark):
    """Recall of the alignment alone on planted copies: other first words, some words replaced, cut inside the text."""
    r = random.Random(12)
    docs, planted = [], set()
    for i in range(150):
        words = [f"word{r.randrange(5000)}" for _ in range(r.randrange(60, 140))]
        copy = words[:]
        copy[0] = "other"
        for _ in range(len(words) // 60):
            copy[r.randrange(10, len(words) // 2)] = "changed"
        short = " ".join(copy[: len(copy) - r.randrange(1, 4)])
        docs += [(2 * i, " ".join(words)), (2 * i + 1, short[: len(short) - r.randrange(3)])]
        if minhash.jaccard(minhash.shingles(docs[-1][1]), minhash.shingles(docs[-2][1])) >= minhash.SIMILARITY:
            planted.add(2 * i + 1)
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("doc_type", F.lit("a")).withColumn("source", F.lit("s"))
    ends = truncation.closings(df)
    found = truncation.aligned(df, truncation.distinct_texts(ends), truncation.facts(df, np.zeros(1 << 10, bool), np.zeros(1 << 10, bool)))
    got = {x for (x,) in rows(ends.join(found, "h").select("doc_id"))}
    assert len(planted) > 60 and got <= {d for d, _ in docs if d % 2} and len(got & planted) >= 0.97 * len(planted)


def test_canonical_spelling():
    assert truncation.canonical("\ufeffa\u00ad b \t\u00a0c  d \r\n e\u2028f\rg \n") == "a b c d\ne\nf\ng"
    assert truncation.canonical(None) == truncation.canonical(" \n\u200b") == "" and truncation.canonical("o\ufb01 x") == "ofi x"


def test_words_before_a_closing_tag_count():
    line, before, word, form, flags = truncation.closing("<p>One is 12.</p><br/><p>It was spoi</p>")
    assert (line, before, word, form) == ("It was spoi", "was", "spoi", "</p>") and flags & truncation.TAGGED and not flags & truncation.ENDS
    assert truncation.closing("<p>It was 3.5.</p>")[4] & truncation.ENDS
    assert truncation.closing("-- the group 12")[::2] == ("-- the group #", "#", truncation.APART | truncation.BRIEF | truncation.FEW)


def test_places_equal_counting():
    canons, kinds = ["a b\nb c\na b", "<p>a b</p><p>a b</p>", "", "b"], np.zeros(4, np.uint64)
    pw, kw, ends = truncation.places(canons, kinds, truncation._Shapes())
    h = lambda w: np.array([truncation._Shapes()[w] if w else truncation._EMPTY], np.uint64)
    key = lambda p, w: tuple(int(k[0]) for k in truncation.word_keys(np.zeros(1, np.uint64), h(p), h(w)))
    want = [("", "a", 0), ("a", "b", 1), ("", "b", 0), ("b", "c", 1), ("", "a", 0), ("", "a", 0), ("a", "b", 1), ("", "a", 0)]
    assert list(zip(pw.tolist(), kw.tolist(), ends.tolist())) == [(*key(p, w), bool(e)) for p, w, e in want]
    assert [x.tolist() for x in truncation.counted(np.array([5, 3, 5]), np.array([True, False, False]))] == [[3, 5], [0, 1], [1, 1]]
    assert all(len(x) == 0 for x in truncation.places(["", "x"], kinds[:2], truncation._Shapes()))


def test_numbers_have_one_spelling():
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice("abcf0 19gz.#") for _ in range(r.randrange(30)))
        assert truncation.numbered(t) == re.sub("[0-9a-f]*[0-9][0-9a-f]*", "#", t)


def test_slices_hold_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"text": pa.array(["x" * n for n in (5, truncation.SLICE, 0, 3, truncation.SLICE - 1, 2)] + [None]), "i": list(range(7))})
    for batch in (b, b.slice(2)):
        parts = list(truncation._slices(iter([batch])))
        assert [i for p in parts for i in p.column("i").to_pylist()] == batch.column("i").to_pylist()
        assert all(p.num_rows == 1 or sum(map(len, filter(None, p.column("text").to_pylist()))) <= truncation.SLICE for p in parts)


def test_hot_bucket_is_split(spark):
    body = " ".join(f"word{i}" for i in range(80))
    docs = [f"Note {i} {body} was kept." for i in range(200)] + [f"Zone {i} {body} was" for i in range(3)]
    texts = spark.createDataFrame([(t,) for t in docs], "canon string").withColumn("h", F.xxhash64("canon"))
    pairs = truncation.candidates(texts.select(F.lit(1).alias("key"), "h"), texts)
    assert pairs.count() == 3 * 200 and pairs.select("short").distinct().count() == 3
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        short, other = (spark.range(n).select(F.lit(1).alias("key"), F.lit(2).alias("sub"), F.col("id").cast("string").alias(c)) for n, c in ((3, "short"), (200, "other")))
        joined = truncation.sub_key_pairs(short.hint("merge"), other)
        assert joined.count() == 600 and joined.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_candidates_hold_every_early_end(spark):
    r = random.Random(11)
    base = [f"{w}{r.choice(['', '', ',', '.', '。'])}" for w in (r.choice(["mask", "lesion", "view", "x", "画像は"]) for _ in range(70))]
    texts = set()
    for _ in range(120):
        t = "".join(w + r.choice(["\n"] + [" "] * 12) for w in base[: r.randrange(60, 70)])
        texts.add(t[: len(t) - r.randrange(9)].strip(" \n"))
    texts |= {"a", "a b", "a b c", "a\nb\nc\nd\ne f", "a\nb\nc\nd\ne f g"}
    for x in texts:
        for y in texts:
            if x != y and truncation.ends_early(x, y):
                assert set(truncation.end_keys(x)) & set(truncation.inner_keys(y))


def test_aligned_copy():
    a = " ".join(f"word{i}" for i in range(60))
    assert truncation.ends_early(a, a + " and goes on.")
    assert not truncation.ends_early(a + ".", a + ". Another sentence.")
    assert not truncation.ends_early(a, a + "\nanother line")
    assert not truncation.ends_early(a[:40], a)


def test_minhash_finds_near_copies():
    r = random.Random(3)
    texts = []
    for _ in range(50):
        a = [f"w{r.randrange(900)}" for _ in range(120)]
        texts += [" ".join(a), " ".join([*a, "tail"])]
    at, keys = minhash.band_keys([*texts, "", "one two", "a b c d e"], minhash.Hashes())
    assert at.tolist() == [*range(100), 102] and keys.shape == (101, minhash.BANDS)
    assert all(set(keys[i]) & set(keys[i + 1]) for i in range(0, 100, 2)) and len(np.unique(keys[100])) == minhash.BANDS
    alone = minhash.band_keys(texts[7:8], minhash.Hashes(4))
    assert np.array_equal(alone[1][0], keys[7])
    s, t = minhash.shingles("a b c d e f"), minhash.shingles("a b c d e g")
    assert minhash.jaccard(s, t) == pytest.approx(1 / 3) and len(minhash.shingles("")) == 0
