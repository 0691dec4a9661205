"""Language identification by rank-order profiles of character n-grams.

A text becomes lower-case letters with single blanks at word edges; its 1- to 3-grams that hold no
inner blank are ranked by count, ties by code points. A language's profile is the PROFILE most
frequent n-grams of its training texts. The language with the smallest out-of-place distance wins:
the sum, over the text's PROFILE most frequent n-grams, of the differences between ranks, and PROFILE
for an n-gram that the profile lacks. score = 1 - distance / largest possible distance.

Training takes labelled documents whose crc32(doc_id as text) mod 5 is not 0, at most about SAMPLE of
each language (a documented bound of the fit: those with the smallest hashes of doc_id, whole texts).
Every document is scored on its whole text, in one map without a shuffle.

Defined results: null text, or one without a letter: und, score 0. A text with letters of which no
profile knows an n-gram gets the first language with score 0. Without training rows all are und.
Equal distances go to the alphabetically first language. A null doc_id is not held out and not
learned from. Repeated rows each get a row; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, written
from tessera.session import table

PROFILE, SAMPLE, FOLDS = 300, 2000, 5
#: Languages whose sampling shares may be broadcast, by a count made before; beyond it the join is a shuffle.
SMALL = 100_000
BLANK = 32
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, up to three code points of 21 bits each in an int64; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, points, BLANK)[keep].astype(np.int64)
    c = np.concatenate((c[:0] if c[0] == BLANK else np.array([BLANK]), c, c[:0] if c[-1] == BLANK else np.array([BLANK])))
    solid = c != BLANK
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[solid], two, three[solid[1:-1]]))


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(g):
        return g, np.zeros(0, np.int64)
    g = np.sort(g)
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[first], np.diff(np.append(first, len(g)))


def ranked(g: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent n-grams, ties by value."""
    values, n = counted(g)
    return values[np.argsort(-n, kind="stable")[:k]]


class Profiles:
    """Ranks of the n-grams of all languages."""

    def __init__(self, by_lang: dict[str, np.ndarray]):
        self.langs = sorted(by_lang)
        self.grams = np.unique(np.concatenate([*by_lang.values(), np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, by_lang[lang]), k] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text else np.zeros(0, np.int64)
        if not len(g) or not self.langs:
            return "und", 0.0
        top = ranked(g)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        known = np.flatnonzero(self.grams[at] == top)
        r = self.ranks[at[known]]
        distance = np.where(r < 0, PROFILE, np.abs(r - known[:, None].astype(np.int32))).sum(0) + PROFILE * (len(top) - len(known))
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(top)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text))
        for lang, parts in by.items():
            values, n = counted(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from the training folds, in one ranked aggregation. Goes to the driver: PROFILE n-grams a language."""
    small_batches(spark)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = written(spark, rows.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count(F.lit(1))).alias("share")), "langid-sizes")
    shares = F.broadcast(sizes) if sizes.count() <= SMALL else sizes
    picked = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)).alias("at")).join(shares, "lang").where(F.col("at") < F.col("share") * 1_000_003)
    counts = picked.select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # ties by gram; Spark keeps the first PROFILE of each language in each task before its shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "rank", "gram").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    by: dict[str, list[int]] = {}
    for lang, gram in zip(top["lang"].to_pylist(), top["gram"].to_pylist(), strict=True):
        by.setdefault(lang, []).append(gram)
    return Profiles({lang: np.array(found, np.int64) for lang, found in by.items()})


def _predict(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [profiles.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            rest = [(batch.schema.field(i).name, batch.column(i)) for i in range(batch.num_columns) if batch.schema.field(i).name != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.float64())], [*(n for n, _ in rest), "lang_pred", "score"])

    return run


def predict(spark: SparkSession, docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of whole texts."""
    small_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(_predict(profiles), "doc_id bigint, lang_pred string, score double")


def keep_known(spark: SparkSession, docs: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """The documents whose language is told with a score of at least `least`; all columns stay as they are."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [profiles.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in made], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = predict(spark, docs, train(spark, docs))
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
