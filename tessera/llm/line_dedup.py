"""Line dedup by an exact set-similarity join with prefix, positional, length and bitmap filters.

A line is the set of its words (runs of letters and digits, A-Z lower-cased). A line is removed if an
earlier one, itself removed or not, has a Jaccard similarity of at least percent / 100 with it. Lines
are in the order of doc_id (null last), then of the text's hash, then of their place in the text.

Equal sets form a class whose first line stands for it. Words are ordered by rarity, estimated from
the counts of 2**BITS hash buckets over the whole corpus (a table of fixed size; ties by hash, so the
order is total and the join exact whatever the counts). Of a class with n words the first
n - ceil(t * n) + 1 are its prefix; a shorter partner needs n - ceil(2t / (1 + t) * n) + 1 of them. Two
classes meet where prefixes share a word, and go on if their lengths, the words' positions and the
parity of their 128-bit bitmaps allow the similarity. Only then words are fetched, and Jaccard is
verified exactly.

Large groups of variants of one line would give all their pairs. So in groups of
CROWD classes or more by one of two minwise words each class first meets the earliest one; the classes
found to be later matches there are settled, and the join asks only for pairs with an open class. No
decision is lost: a settled class still serves as the earlier one. The join is a sort-merge join on the
word, which Spark can split.

Defined results: null text has one empty line; lines without words are never removed. Rows that repeat
doc_id and text are one document and give equal results. Further columns are ignored by the report
and kept by without_repeated_lines(). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.native import let
from tessera.llm.shared import forget, small_batches, text_hash, written
from tessera.llm.textarrays import ALNUM, mixed, spread, text_blocks, words
from tessera.session import table

BITS = 21
BUCKETS = 1 << BITS
#: Most lines of a block that are sorted by one packed number.
PACKED_LINES = 1 << 20
#: Rows that may be broadcast, by a count made before; beyond it the join is a shuffle.
SMALL = 500_000
#: From this many classes with one minwise word on, the earliest of them meets the others before the join.
CROWD = 16
#: Parts of the words that are joined one after the other; more parts take less disk and read the classes more often.
PASSES = 2
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
LINES = "doc_id bigint, th bigint, line int, n int, key bigint, sig bigint, sig2 bigint, prefix array<int>, near array<bigint>"


class Lines:
    """The lines of a block of texts that have words, as sets: hashes in order of line and rarity."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, rarity: np.ndarray | None):
        breaks = np.flatnonzero(data == 10) + 1
        edges = np.union1d(bounds, breaks)
        edges = edges if len(edges) and edges[0] == 0 else np.concatenate(([0], edges))
        h, _, _, first = words(data, edges, ALNUM)
        line = np.repeat(np.arange(len(edges) - 1), np.diff(first))
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
        if rarity is None:
            self.buckets = bucket
            return
        # one sort by line, rank of the bucket and the hash's next bits; two words of a line that agree in all of them are so rare that a full sort may follow
        rest = np.uint64(44 - BITS)
        packed = (line.astype(np.uint64) << np.uint64(44)) | (rarity[bucket].astype(np.uint64) << rest) | ((h >> np.uint64(20)) & ((np.uint64(1) << rest) - np.uint64(1)))
        order = np.argsort(packed) if len(edges) <= PACKED_LINES else np.lexsort((h, rarity[bucket], line))
        packed = packed[order]
        if len(edges) <= PACKED_LINES and ((packed[1:] == packed[:-1]) & (h[order[1:]] != h[order[:-1]])).any():
            order = np.lexsort((h, rarity[bucket], line))
        h, line = h[order], line[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1]))) if len(h) else np.zeros(0, bool)
        self.h, line = h[new], line[new]
        self.starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.starts, len(self.h)))
        present = line[self.starts]
        #: Text of each line with words, its number there, and how many lines each text has.
        self.text = np.searchsorted(bounds, edges[present], "right") - 1
        before = np.searchsorted(breaks, bounds[:-1], "right")
        self.number = np.searchsorted(breaks, edges[present], "right") - before[self.text]
        inside = np.searchsorted(breaks, bounds[1:], "right") - before
        self.n_lines = inside + 1


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, data, bounds in text_blocks(batch.column(0)):
            np.add.at(total, Lines(data, bounds, None).buckets, 1)
    at = np.flatnonzero(total > 1)  # what a task met once is rare anyway
    for k in range(0, len(at), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(total[at[k : k + 100_000]])], ["bucket", "n"])


def rarity(spark: SparkSession, docs: DataFrame) -> np.ndarray:
    """Rank of each hash bucket of words by its count over all documents: BUCKETS numbers come to the driver, however large the corpus."""
    small_batches(spark)
    counts = docs.select("text").mapInArrow(_bucket_counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    found = counts.toArrow()
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return np.argsort(np.argsort(out, kind="stable"), kind="stable").astype(np.uint32)


def _lines(rare: Broadcast, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0), batch.column(1)
            for a, b, data, bounds in text_blocks(batch.column(2)):
                x = Lines(data, bounds, rare.value)
                # a row for each text with its count of lines as n, in place of line -1
                texts = b - a
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, texts), th.slice(a, texts), pa.array(np.full(texts, -1, np.int32)), pa.array(x.n_lines.astype(np.int32)), *[pa.nulls(texts, pa.int64())] * 3, pa.nulls(texts, pa.list_(pa.int32())), pa.nulls(texts, pa.list_(pa.int64()))],
                    NAMES,
                )
                if not len(x.h):
                    continue
                size = x.sizes
                key = mixed(np.add.reduceat(mixed(x.h), x.starts) + size.astype(np.uint64))
                bit = np.uint64(1) << ((x.h >> np.uint64(57)) & np.uint64(63))
                upper = (x.h >> np.uint64(63)).astype(bool)
                sig, sig2 = (np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), x.starts) for half in (upper, ~upper))
                near = np.stack([np.minimum.reduceat(mixed(x.h ^ s), x.starts) for s in _SEEDS], 1)
                near[:, 1] ^= _SEEDS[0]
                p = size - (percent * size + 99) // 100 + 1
                prefix = (x.h[spread(x.starts, p)] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rows = pa.array(a + x.text)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), th.take(rows), pa.array(x.number.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(sig.view(np.int64)), pa.array(sig2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(p))).astype(np.int32)), pa.array(prefix)), pa.ListArray.from_arrays(pa.array((np.arange(len(size) + 1) * 2).astype(np.int32)), pa.array(near.ravel().view(np.int64)))],
                    NAMES,
                )

    return run


NAMES = [x.split()[0] for x in LINES.split(", ")]


def _members(rare: Broadcast):
    """(doc_id, th, line, members) of the wanted lines of each text (doc_id, th, text, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for a, _, data, bounds in text_blocks(batch.column(2)):
                x = Lines(data, bounds, rare.value)
                sets = {t: set(wanted[a + t]) for t in np.unique(x.text).tolist()}
                keep = np.array([k for k, (t, n) in enumerate(zip(x.text.tolist(), x.number.tolist(), strict=True)) if n in sets[t]], np.int64)
                if not len(keep):
                    continue
                size = x.sizes[keep]
                flat = pa.array(x.h[spread(x.starts[keep], size)].view(np.int64))
                offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                rows = pa.array(a + x.text[keep])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x.number[keep].astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "th", "line", "members"])

    return run


class LineJoin:
    """One run of the join; .lines has a row for each line with words, .removed the classes that have an earlier match."""

    def __init__(self, spark: SparkSession, docs: DataFrame, percent: int = 80):
        small_batches(spark)
        self.spark, self.percent = spark, percent
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash("text").alias("th"), "text")
        self.rare = spark.sparkContext.broadcast(rarity(spark, docs))
        self.lines = written(spark, self.docs.mapInArrow(_lines(self.rare, percent), LINES), "lines")
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "line")
        classes = self.lines.where("line >= 0").groupBy("key", "sig", "sig2", "n").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("c"), F.first("prefix").alias("prefix"), F.first("near").alias("near"))
        self.classes = written(spark, classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "line-classes")
        self.spent: list[DataFrame] = []
        stars = self.verified(self.stars())
        self.removed = written(spark, stars.unionByName(self.verified(self.pairs(stars))).distinct(), "line-removed")

    def may_match(self, x: dict[str, Column], y: dict[str, Column]) -> Column:
        """Length and bitmap filter: the bits where parities differ are at most the words not shared."""
        return (100 * F.least(x["n"], y["n"]) >= self.percent * F.greatest(x["n"], y["n"])) & self.near_bits(x, y)

    def near_bits(self, x: dict[str, Column], y: dict[str, Column]) -> Column:
        """2 * overlap <= n + n - bits, where similarity asks for (100 + percent) * overlap >= percent * (n + n); all in whole numbers."""
        bits = F.bit_count(x["sig"].bitwiseXOR(y["sig"])) + F.bit_count(x["sig2"].bitwiseXOR(y["sig2"]))
        return (100 + self.percent) * (x["n"] + y["n"] - bits) >= 2 * self.percent * (x["n"] + y["n"])

    def stars(self) -> DataFrame:
        """(a, b): each class and the earliest class with one of its minwise words, where CROWD classes or more share it and the filters let them pass."""
        rows = self.classes.select(F.explode("near").alias("w"), F.coalesce("first.doc_id", F.lit(2**63 - 1)).alias("d"), "cid", F.col("n").cast("bigint").alias("n"), "sig", "sig2")
        groups = rows.groupBy("w").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= CROWD).drop("c")
        groups = written(self.spark, groups, "line-crowds")
        met = written(self.spark, rows.join(F.broadcast(groups) if groups.count() <= SMALL else groups, "w"), "line-near")
        self.spent += [groups, met]
        hubs = met.where("d = least").groupBy("w").agg(F.min(F.struct("cid", "n", "sig", "sig2")).alias("h"))
        met = met.select("w", "cid", "n", "sig", "sig2").join(hubs, "w").where(F.col("cid") != F.col("h.cid"))
        one, two = ({c: F.col(f"{at}{c}") for c in ("n", "sig", "sig2")} for at in ("", "h."))
        return met.where(self.may_match(one, two)).select(F.col("cid").alias("a"), F.col("h.cid").alias("b"))

    def pairs(self, settled: DataFrame) -> DataFrame:
        """(a, b): pairs that share a prefix word and pass the filters, unless both are settled. In PASSES parts of the words, so that the exchange of one part is gone before the next."""
        flags = settled.withColumn("settled", F.lit(1))
        flags = F.broadcast(flags) if settled.count() <= SMALL else flags
        rows = self.classes.select("cid", "n", "sig", "sig2", "prefix").join(flags, "cid", "left")
        t = rows.select(F.posexplode("prefix").alias("pos", "w"), "cid", "n", "sig", "sig2", F.coalesce("settled", F.lit(0)).alias("settled"))
        # n, pos and settled in one number: rows of the exchange stay narrow
        t = t.select("w", "cid", "sig", "sig2", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("bigint"), 1)).bitwiseOR(F.col("settled").cast("bigint")).alias("meta"))
        y, x = ({"w": F.col(f"{at}.w"), "cid": F.col(f"{at}.cid"), "sig": F.col(f"{at}.sig"), "sig2": F.col(f"{at}.sig2"), "n": F.shiftright(f"{at}.meta", 32), "pos": F.shiftright(f"{at}.meta", 1).bitwiseAND(2**31 - 1), "open": F.col(f"{at}.meta").bitwiseAND(1) == 0} for at in "yx")
        p, q = self.percent, 100 + self.percent
        shorter = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["cid"] < y["cid"]))
        lengths = 100 * x["n"] >= p * y["n"]
        index = q * (x["n"] - x["pos"]) >= 2 * p * x["n"]
        position = q * F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= p * (x["n"] + y["n"])
        on = (x["w"] == y["w"]) & shorter & lengths & (x["open"] | y["open"]) & index & position & self.near_bits(x, y)
        parts = []
        for k in range(PASSES):
            part = t.where(F.pmod("w", F.lit(PASSES)) == k) if PASSES > 1 else t
            met = part.alias("y").join(part.alias("x"), on)
            parts.append(written(self.spark, met.select(x["cid"].alias("a"), y["cid"].alias("b")), "line-part"))
        self.spent += parts
        return reduce(DataFrame.unionByName, parts)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """cid of the later class of each pair whose Jaccard similarity, on full sets, is high enough."""
        pairs = written(self.spark, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
        met = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        met = written(self.spark, met.join(self.classes.select("cid", "first"), "cid").select("cid", "first", F.col("first.doc_id").alias("m_id"), F.col("first.th").alias("m_th"), F.col("first.line").alias("m_line")), "line-met")
        wanted = met.groupBy("m_id", "m_th").agg(F.collect_set("m_line").alias("lines"))
        wanted = F.broadcast(wanted) if met.count() <= SMALL else wanted
        same = (F.col("th") == F.col("m_th")) & F.col("doc_id").eqNullSafe(F.col("m_id"))
        made = self.docs.join(wanted, same).select("doc_id", "th", "text", "lines").mapInArrow(_members(self.rare), "doc_id bigint, th bigint, line int, members array<bigint>")
        sets = written(self.spark, made.dropDuplicates(["doc_id", "th", "line"]).join(met, same & (F.col("line") == F.col("m_line"))).select("cid", "first", "members"), "line-sets")
        side = lambda s: sets.select(F.col("cid").alias(s), F.col("first").alias(f"f_{s}"), F.col("members").alias(f"m_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("m_a", "m_b"))
        similar = 100 * common >= self.percent * (F.size("m_a") + F.size("m_b") - common)
        later = both.where(similar).select(F.when(F.col("f_a") > F.col("f_b"), F.col("a")).otherwise(F.col("b")).alias("cid")).distinct()
        later = written(self.spark, later, "line-later")
        forget(pairs, met, sets, *self.spent)
        self.spent.clear()
        return later

    def removed_lines(self) -> DataFrame:
        """doc_id, th, lines: the numbers of a document's removed lines, ascending; only documents with any.

        A class of one line goes or stays by itself; only classes of several lines are joined with the lines.
        """
        flags = self.removed.withColumn("gone", F.lit(True))
        flags = F.broadcast(flags) if self.removed.count() <= SMALL else flags
        classes = self.classes.select("cid", "key", "sig", "sig2", "n", "c", "first").join(flags, "cid", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        alone = classes.where("gone AND c = 1").select("first.doc_id", "first.th", "first.line")
        several = written(self.spark, classes.where("c > 1").select("key", "sig", "sig2", "n", "first", "gone"), "line-several")
        rows = self.lines.where("line >= 0").select("doc_id", "th", "line", "key", "sig", "sig2", "n")
        rows = rows.join(F.broadcast(several) if several.count() <= SMALL else several, ["key", "sig", "sig2", "n"])
        here = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "line")
        rows = rows.where(F.col("gone") | (here != F.col("first"))).select("doc_id", "th", "line")
        return rows.unionByName(alone).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _joined(left: DataFrame, removed: DataFrame) -> DataFrame:
    removed = removed.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), F.col("lines").alias("r_lines"))
    return left.join(removed, (left["th"] == removed["r_th"]) & left["doc_id"].eqNullSafe(removed["r_id"]), "left")


def line_report(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined); a row for each document."""
    run = LineJoin(spark, docs, percent)
    docs = run.lines.where("line < 0").select("doc_id", "th", F.col("n").cast("bigint").alias("n_lines"))
    out = _joined(docs, run.removed_lines())
    lines = F.coalesce("r_lines", F.expr("cast(array() as array<int>)"))
    return out.select("doc_id", "n_lines", F.size(lines).cast("bigint").alias("n_removed"), F.array_join(F.transform(lines, lambda x: x.cast("string")), ",").alias("removed_lines"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the removed lines taken out of text; documents that lose all their lines go. All columns stay; n_chars follows the text where there is one."""
    columns = docs.columns
    run = LineJoin(spark, docs, percent)
    removed = written(spark, run.removed_lines(), "line-lists")
    forget(run.lines, run.classes, run.removed)
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_hash("text").alias("th"))
    out = _joined(rows, F.broadcast(removed) if removed.count() <= SMALL else removed)
    kept = let(F.split(F.col("row.text"), "\n", -1), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("r_lines")), lambda i: x[i]))
    new = F.when(F.col("r_lines").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    out = out.withColumn("new", new).where(F.col("r_lines").isNull() | (F.trim("new") != ""))
    put = {"text": F.col("new"), "n_chars": F.when(F.col("r_lines").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else None}
    return out.select(*(put[c].alias(c) if put.get(c) is not None else F.col(f"row.`{c}`") for c in columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark, table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
li AS (
  SELECT doc_id, j - 1 AS line, list_distinct(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS j FROM d)
), ne AS (SELECT *, len(w) AS n, row_number() OVER (ORDER BY doc_id, line) AS r FROM li WHERE len(w) > 0),
x AS (SELECT r, n, unnest(w) AS t FROM ne),
f AS (SELECT t, count(*) AS c FROM x GROUP BY t),
p AS (
  SELECT r, n, t FROM (SELECT r, n, t, row_number() OVER (PARTITION BY r ORDER BY c, t) AS k FROM x JOIN f USING (t))
  WHERE k <= n - (80 * n + 99) // 100 + 1
), c AS (
  SELECT DISTINCT a.r AS late, b.r AS early FROM p a JOIN p b USING (t)
  WHERE a.r > b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), v AS (
  SELECT late, a.n + b.n AS n, len(list_intersect(a.w, b.w)) AS k FROM c JOIN ne a ON a.r = late JOIN ne b ON b.r = early
), g AS (
  SELECT doc_id, count(*) AS n, string_agg(line, ',' ORDER BY line) AS lines
  FROM ne WHERE r IN (SELECT late FROM v WHERE 100 * k >= 80 * (n - k)) GROUP BY doc_id
)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(lines, '') AS removed_lines FROM d LEFT JOIN g USING (doc_id)
"""
