"""Licence scan by ordered signature rules, in DataFrame operations only.

A text becomes its lower-case words between single blanks. Substring gates settle most texts; for the
others each rule whose keyword is present runs its regex over the whole text. Overlapping detections
are resolved by interval containment: a detection goes if another one that is at least as wide holds
it and has at least its priority; of equal ones the earlier rule stays. A map over rows, no shuffle.

Defined results: null text counts as empty; without words n_words is 0 and score 0; first_word and
last_word are null without a base phrase; labels are '' where there are none. Repeated rows and null
doc_ids each give their own row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.license_rules import GATES, RULES
from tessera.llm.native import blanks, let, matches, spaced_words
from tessera.session import table

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Score of a surviving detection by its rule's priority.
CONFIDENCE = (0.2, 0.6, 0.8, 0.9, 1.0)


def _rules() -> Column:
    return F.array(*(F.struct(F.lit(n).alias("no"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(f"(?<= )(?:{rx})(?= )").alias("rx")) for n, (label, p, k, rx) in enumerate(RULES)))


def detections(words: Column) -> Column:
    """All matches of all rules in words (see spaced_words): array of (start, -end, -priority, no, label), sorted, code points of words."""
    gated = F.lit(False)
    for g in GATES:
        gated = gated | F.contains(words, F.lit(g))
    hits = F.transform(
        F.filter(_rules(), lambda r: F.contains(words, r["keyword"])),
        lambda r: F.transform(matches(words, r["rx"]), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), (-r["priority"]).alias("rank"), r["no"].alias("no"), r["label"].alias("label"))),
    )
    none = F.expr("cast(array() as array<struct<start:bigint,back:bigint,rank:int,no:int,label:string>>)")
    return F.when(gated, F.sort_array(F.flatten(hits))).otherwise(none)


def surviving(found: Column) -> Column:
    """(labels, best) of the detections that no other one suppresses.

    In order of start, then falling end, then falling priority, whatever holds a detection comes
    before it; so it is suppressed exactly if, of its priority or a higher one, the furthest end so
    far reaches its end.
    """
    levels = len(CONFIDENCE)
    zero = F.struct(F.expr("cast(array() as array<string>)").alias("labels"), F.lit(-1).alias("best"), F.array(*[F.lit(-1).cast("long")] * levels).alias("reach"))

    def step(acc: Column, d: Column) -> Column:
        end, p = -d["back"], -d["rank"]
        new = acc["reach"][p] < end
        reach = F.transform(acc["reach"], lambda r, k: F.when(k <= p, F.greatest(r, end)).otherwise(r))
        return F.struct(F.when(new, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"), F.when(new, F.greatest(acc["best"], p)).otherwise(acc["best"]).alias("best"), reach.alias("reach"))

    return F.aggregate(found, zero, step)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = docs.select("doc_id", spaced_words(F.col("text")).alias("w"))
    w = F.col("w")
    first, last, count, base = [], [], [], []
    for phrase, label in BASE:
        pattern, k = f"(?<= ){phrase}(?= )", len(phrase.split())
        here = F.contains(w, F.lit(f" {phrase} "))
        pieces = F.when(here, F.split(w, F.lit(pattern), -1))
        found = let(pieces, lambda p: F.struct((F.size(p) - 1).cast("long").alias("n"), (blanks(p[0]) - 1).alias("first"), (blanks(F.element_at(p, -1)) - 1).alias("back")))
        count.append(F.when(here, found["n"]).otherwise(F.lit(0).cast("long")).alias(f"n_{label}"))
        first.append(F.when(here, found["first"]).alias(f"first_{label}"))
        last.append(F.when(here, found["back"] + k).alias(f"back_{label}"))
        base.append(label)
    out = words.select("doc_id", F.when(w == " ", F.lit(0).cast("long")).otherwise(blanks(w) - 1).alias("n_words"), surviving(detections(w)).alias("s"), *count, *first, *last)
    present = F.filter(F.array(*(F.when(F.col(f"n_{x}") > 0, F.lit(x)) for x in base)), lambda x: x.isNotNull())
    n_base = sum((F.col(f"n_{x}") for x in base), F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*(F.col(f"first_{x}") for x in base)).alias("first_word"),
        (F.col("n_words") - F.least(*(F.col(f"back_{x}") for x in base))).alias("last_word"),
        F.concat_ws(",", F.sort_array(present)).alias("base_labels"),
        F.concat_ws(",", F.sort_array(F.array_distinct(F.concat(present, F.col("s.labels"))))).alias("labels"),
        F.greatest(F.when(n_base > 0, F.lit(CONFIDENCE[1])).otherwise(F.lit(0.0)), F.when(F.col("s.best") >= 0, F.array(*map(F.lit, CONFIDENCE))[F.col("s.best")]).otherwise(F.lit(0.0))).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
