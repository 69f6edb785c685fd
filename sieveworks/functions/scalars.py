"""Scalar operators of the curation pipeline as JVM column expressions."""

from __future__ import annotations

import hashlib
import json
import subprocess

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered rules, first whose needles all occur in the lower-cased path wins.
DATASET_RULES = [
    ("kvasir-seg-masks", ["kvasir-seg", "masks"]),
    ("kvasir-seg-images", ["kvasir-seg", "images"]),
    ("hyperkvasir-labeled", ["labeled-images"]),
    ("hyperkvasir-segmented", ["segmented-images"]),
]
#: Letters that name the options of a prompt.
LETTERS = "ABCDEFGH"
INSTRUCTION = "Answer with the letter of one option."


def classify(p: Column, rules: list[tuple[str, list[str]]] | None = None, default: str = "unclassified") -> Column:
    """Name of the first rule whose needles are all substrings of the path."""
    low = F.lower(F.regexp_replace(p, r"\\", "/"))
    out = F.lit(default)
    for name, needles in reversed(DATASET_RULES if rules is None else rules):
        cond = F.lit(True)
        for n in needles:
            cond = cond & low.contains(n)
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def class_label(p: Column, dataset: Column) -> Column:
    """Name of the parent folder, null for the segmentation set."""
    parts = F.split(F.regexp_replace(p, r"\\", "/"), "/")
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    return F.when(~dataset.startswith("kvasir-seg"), parent)


def stem(p: Column) -> Column:
    """File name without folders and without its last suffix."""
    return F.regexp_extract(p, r"([^/]+?)(\.[^./]*)?$", 1)


def keyed_id(*parts: Column, n: int = 16) -> Column:
    """First n hex digits of the sha256 of the parts joined by a pipe (null counts as empty)."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, n)


def config_hash(cfg: dict) -> str:
    """12 hex digits over a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(cfg, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def prompt_id(text: Column) -> Column:
    """C7."""
    return F.concat(F.lit("p"), F.substring(F.sha2(text, 256), 1, 10))


def git_revision(cwd: str | None = None) -> str:
    """Short commit id, with a mark if the tree is changed; ``unknown`` outside a repository."""
    try:
        run = lambda *a: subprocess.run(["git", *a], cwd=cwd, capture_output=True, text=True, timeout=20)
        head = run("rev-parse", "--short", "HEAD")
        if head.returncode:
            return "unknown"
        return head.stdout.strip() + ("-dirty" if run("diff", "--quiet").returncode else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def resolved_class(label: Column, pool: Column) -> Column:
    """C11: the class label, else ``polyps`` in the polyp pool, else empty."""
    present = ~F.lower(F.trim(F.coalesce(label, F.lit("")))).isin("", "none", "(none)", "nan", "null", "na")
    return F.when(present, F.trim(label)).when(pool == "polyp", F.lit("polyps")).otherwise(F.lit(""))


def with_abstain(options: Column, abstain: str) -> Column:
    """C12."""
    return F.array_append(options, F.lit(abstain))


def other_options(options: Column, answer: Column) -> Column:
    """The options that are not the answer, order and repeats kept."""
    return F.filter(options, lambda o: o != answer)


def tertile(x: Column, t1: Column, t2: Column) -> Column:
    """C17: bin by two cut points; a value on a cut point belongs to the lower bin."""
    return F.when(x.isNull() | F.isnan(x), "-").when(x <= t1, "small").when(x <= t2, "mid").otherwise("large")


def count_bucket(n: Column) -> Column:
    """C19."""
    return F.when(n <= 0, "0").when(n == 1, "1").when(n >= 2, "2 or more")


def log_softmax(logits: Column) -> Column:
    """C21 over an array of doubles, shifted by the maximum; null for an empty array."""
    top = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    return F.transform(logits, lambda v: v - top - total)


def log_softmax_map(m: Column) -> Column:
    """C21 over a map of option to score."""
    values = F.map_values(m)
    top = F.array_max(values)
    total = F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    return F.transform_values(m, lambda k, v: v - top - total)


def probabilities(m: Column, digits: int = 4) -> Column:
    """C22."""
    return F.transform_values(m, lambda k, v: F.round(F.exp(v), digits))


def build_prompt(question: Column, options: Column, instruction: Column | None = None) -> Column:
    """Instruction, question, lettered options and the answer cue, one per line and apart from each other; at most 8 options."""
    lettered = F.transform(options, lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), o))
    head = F.lit(INSTRUCTION) if instruction is None else instruction
    return F.array_join(F.concat(F.array(head, F.lit(""), F.concat(F.lit("Question: "), question), F.lit("")), lettered, F.array(F.lit(""), F.lit("Answer:"))), "\n")


def ranked(scores: Column) -> Column:
    """H4: (score, position) structs from best to worst, ties to the earlier position."""
    pairs = F.transform(scores, lambda v, i: F.struct((-v).alias("neg"), i.alias("pos")))
    return F.array_sort(pairs)


def argmax_margin(scores: Column) -> tuple[Column, Column]:
    """H4: position of the best score and its distance to the runner-up (infinite if alone)."""
    r = ranked(scores)
    margin = F.when(F.size(r) >= 2, F.try_element_at(r, F.lit(2))["neg"] - F.try_element_at(r, F.lit(1))["neg"]).when(F.size(r) == 1, F.lit(float("inf")))
    return F.try_element_at(r, F.lit(1))["pos"], margin


def hash_order(seed: int | str, *keys: Column) -> Column:
    """The order that stands in for every seeded shuffle: sha256 over seed and keys."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 256)


def shuffled_options(item: Column, options: Column, seed: int | str = 0) -> Column:
    """Options in an order that depends on item, option position and seed only."""
    tagged = F.transform(options, lambda o, i: F.struct(hash_order(seed, item, i).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(tagged), lambda t: t["o"])
