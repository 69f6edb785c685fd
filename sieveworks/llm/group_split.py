"""Problem 3: splits that keep related records together.

Records and entities (groups, authors, sources) form a bipartite graph whose
components must not be divided. Components come from minimum-label propagation;
they are then assigned so that sizes follow the proportions and every split has
about the same distribution of a label.

Components with the same rows per label are a class. From classes of large
components to small ones, a class is dealt in proportion to what the splits still
want of its labels (the given proportions, until a large component upsets them),
and what the rounding leaves of it (fewer members than splits) goes one by one to
the split that rounding owes most. Every component takes part as it is,
whatever its size and the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions.normal import group_number, word
from sieveworks.operators.ranks import hash_rank
from sieveworks.session import cut


def record_groups(records: DataFrame, bank: DataFrame) -> DataFrame:
    """item_id, question_id, split and group of every row of records (not only the latest).

    group is the number in records.group_id, else that of the question in the
    bank (the least, if its rows differ), else null.
    """
    questions = bank.where(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.min(F.col("group_id").cast("bigint")).alias("_bank"))
    rows = records.select("item_id", "question_id", word("split").alias("split"), group_number("group_id").alias("_own"))
    return rows.join(questions, "question_id", "left").select("item_id", "question_id", "split", F.coalesce("_own", "_bank").alias("group_id"))


def conflicts(rows: DataFrame) -> DataFrame:
    """group_id of the groups whose rows carry more than one split; missing splits and groups are ignored."""
    seen = rows.where(F.col("group_id").isNotNull() & F.col("split").isNotNull())
    return seen.groupBy("group_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where(F.col("lo") != F.col("hi")).select("group_id")


def entity_components(links: DataFrame) -> DataFrame:
    """entity, component: entities that share a record, directly or through others, get one component.

    links: record, entity (both of one ordered type, no common values needed:
    labels are those of entities). Null ends link nothing; an entity without a record is alone. Each round gives
    every record the least label of its entities and every entity the least
    label of its records, until no label changes; both steps are aggregations
    with partial combining, so that a hot entity costs one row a task. Records
    with one entity can't join two entities and take no part in the rounds.
    """
    edges = links.where(F.col("record").isNotNull() & F.col("entity").isNotNull()).select("record", "entity")
    several = edges.groupBy("record").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).where(F.col("lo") != F.col("hi")).select("record")
    live = cut(edges.join(several, "record", "left_semi").distinct())
    labels = cut(live.select("entity", F.col("entity").alias("component")).distinct())
    while not live.isEmpty():
        by_record = live.join(labels, "entity").groupBy("record").agg(F.min("component").alias("c"))
        lower = live.join(by_record, "record").groupBy("entity").agg(F.min("c").alias("c"))
        hop = labels.select(F.col("entity").alias("c"), F.col("component").alias("far"))
        nxt = cut(labels.join(lower, "entity").join(hop, "c", "left").select("entity", F.col("component").alias("old"), F.least("component", "c", "far").alias("component")))
        changed = not nxt.where(F.col("old") != F.col("component")).isEmpty()
        labels = nxt.select("entity", "component")
        if not changed:
            break
    every = links.where(F.col("entity").isNotNull()).select("entity").distinct()
    return every.join(labels, "entity", "left").select("entity", F.coalesce("component", "entity").alias("component"))


class Balance:
    """Rows of each label that each split still wants, and how many components of a class each gets."""

    def __init__(self, totals: dict[str, int], shares: list[tuple[str, float]]) -> None:
        norm = sum(p for _, p in shares if p > 0) or 1.0
        self.shares = [(s, p / norm) for s, p in shares if p > 0]
        self.want = {s: {label: n * p for label, n in totals.items()} for s, p in self.shares}
        self.owed = {s: dict.fromkeys(totals, 0.0) for s, _ in self.shares}

    def wanted(self, load: dict[str, int]) -> dict[str, float]:
        """The share of each split in what is still wanted of the labels of a load; the given one of a label that nobody wants.

        What a split has too much of counts against it, so that the labels of a
        load make up for each other, and a label of which little is left counts for
        more, as later classes can't mend it; only the outcome is kept above 0.
        """
        out = {s: 0.0 for s, _ in self.shares}
        for label, n in load.items():
            total = sum(self.want[s][label] for s, _ in self.shares)
            for s, p in self.shares:
                out[s] += (self.want[s][label] / total if total >= 1 else p) * n / max(1.0, total)
        out = {s: max(0.0, x) for s, x in out.items()}
        whole = sum(out.values())
        return {s: x / whole for s, x in out.items()} if whole > 0 else dict(self.shares)

    def deal(self, load: dict[str, int], members: int) -> dict[str, int]:
        """How many of the members of a class go to each split.

        What the rounding down leaves is owed to the splits, per label and in
        components; the members that are left go to the split that is owed most.
        """
        ideal, size = {s: members * p for s, p in self.wanted(load).items()}, sum(load.values())
        out, part = {s: int(x) for s, x in ideal.items()}, {label: n / size for label, n in load.items()}
        for s, x in ideal.items():
            for label, w in part.items():
                self.owed[s][label] += (x - out[s]) * w
        for _ in range(members - sum(out.values())):
            best = max(out, key=lambda s: sum(w * self.owed[s][label] for label, w in part.items()))
            out[best] += 1
            for label, w in part.items():
                self.owed[best][label] -= w
        for s, k in out.items():
            for label, n in load.items():
                self.want[s][label] -= n * k
        return out


def assign(rows: DataFrame, proportions: DataFrame) -> DataFrame:
    """component, split: rows (component, label) of one component get one split; see ``assign_counts``."""
    return assign_counts(rows.groupBy("component", "label").agg(F.count("*").alias("n")), proportions)


def assign_counts(counts: DataFrame, proportions: DataFrame) -> DataFrame:
    """component, split: all rows of one component get one split.

    counts: component (not null), label (null is a label of its own; labels are
    a closed vocabulary), n (rows). proportions: split, proportion, ord; a few rows that
    don't grow with the data. Class rows (a load and its count) stream through
    one task in order of size, which holds what the splits still want and
    nothing else; members find their split by their rank in the class, in
    order of a digest. Without proportions above 0, or rows, there is no row.
    """
    shares = [(r["split"], float(r["proportion"])) for r in proportions.where("split is not null and proportion > 0").groupBy("split").agg(F.max("proportion").alias("proportion"), F.min("ord").alias("ord")).orderBy("ord", "split").collect()]
    counts = counts.select("component", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"), "n")
    loads = counts.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("load"))
    per = cut(loads.select("component", "load", F.md5(F.to_json("load")).alias("kind"), F.md5(F.col("component").cast("string")).alias("digest")))
    classes = per.groupBy("kind").agg(F.first("load").alias("load"), F.count("*").alias("members"))
    classes = cut(classes.withColumn("size", F.aggregate("load", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])))
    totals = {r["label"]: r["n"] for r in classes.select("members", F.explode("load").alias("x")).groupBy("x.label").agg(F.sum(F.col("x.n") * F.col("members")).alias("n")).collect()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Balance(totals, shares)
        for pdf in batches:
            upto = []
            for load, members in zip(pdf["load"], pdf["members"], strict=True):
                last, ends = 0, []
                for split, k in state.deal({x["label"]: int(x["n"]) for x in load}, int(members)).items():
                    last += k
                    ends.append({"split": split, "last": last})
                upto.append(ends)
            yield pd.DataFrame({"kind": pdf["kind"], "upto": pd.Series(upto, dtype=object, index=pdf.index)})

    dealt = cut(classes.select("kind", "load", "members", "size").orderBy(F.desc("size"), "kind").coalesce(1).mapInPandas(deal, "kind string, upto array<struct<split: string, last: bigint>>"))
    ranked = hash_rank(per.select("component", "kind", "digest"), ["kind"], "digest", "component", name="rank")
    return ranked.join(dealt, "kind").select("component", F.filter("upto", lambda x: x["last"] >= F.col("rank"))[0]["split"].alias("split")).where("split is not null")


def placed_rows(records: DataFrame, bank: DataFrame) -> DataFrame:
    """group_id, label (pool of the question), present (split) and component of every row of records.

    The entities that keep records together are their groups; a record whose
    row lacks the group takes that of its question. Rows without a group are a
    component each, by question and item.
    """
    pools = bank.where(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.min(word("pool")).alias("label"))
    rows = cut(record_groups(records, bank).join(pools, "question_id", "left").select(F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat_ws("|", F.lit("r"), "item_id", "question_id")).alias("entity"), F.col("item_id").alias("record"), "group_id", "label", F.col("split").alias("present")))
    return cut(rows.join(entity_components(rows.select("record", "entity")), "entity").select("group_id", "label", "present", "component"))


def split_records(records: DataFrame, bank: DataFrame, proportions: DataFrame) -> DataFrame:
    """One row per group of records: group_id, component, n (rows), lo and hi (least and greatest present split, null if none) and the assigned split; rows without a group are a component each."""
    placed = placed_rows(records, bank)
    groups = placed.groupBy("group_id", "component").agg(F.count("*").alias("n"), F.min("present").alias("lo"), F.max("present").alias("hi"))
    return groups.join(assign(placed.select("component", "label"), proportions), "component").select("group_id", "component", "n", "lo", "hi", "split")


def balance(records: DataFrame, bank: DataFrame, proportions: DataFrame) -> DataFrame:
    """split, label, rows, share (of the label's rows), wanted and deviation; label is null for rows without one and ``(all)`` for the sizes of the splits."""
    placed = cut(placed_rows(records, bank).groupBy("component", "label").agg(F.count("*").alias("n")))
    got = placed.join(assign_counts(placed, proportions), "component")
    per = got.groupBy("split", "label").agg(F.sum("n").alias("rows")).unionByName(got.groupBy("split").agg(F.sum("n").alias("rows")).withColumn("label", F.lit("(all)")))
    totals = per.groupBy("label").agg(F.sum("rows").alias("_total")).withColumnRenamed("label", "_label")
    wanted = proportions.where("split is not null and proportion > 0").groupBy("split").agg(F.max("proportion").alias("wanted"))
    out = per.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("_label"))).join(F.broadcast(wanted), "split")
    share = F.col("rows") / F.col("_total")
    return out.select("split", "label", "rows", share.alias("share"), "wanted", (share - F.col("wanted")).alias("deviation"))


def divided(placed: DataFrame) -> DataFrame:
    """group_id of the placed groups (of ``split_records``) whose rows carry more than one present split; missing splits and groups are ignored."""
    return placed.where(F.col("group_id").isNotNull() & (F.col("lo") != F.col("hi"))).select("group_id")
