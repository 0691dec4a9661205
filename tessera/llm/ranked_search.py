"""Ranked lexical search over dual-sorted wavelet trees, one a shard of documents.

Index. A shard holds the documents of some megabytes of text, numbered in order of doc_id. Its postings stand
term after term, each term's documents by falling impact. One wavelet tree over the sequence of document
numbers, stored level by level, sorts the same postings the other way: a node is a range of document numbers,
a term is an interval in it, and within the interval the documents still stand by falling impact. So the
first posting of an interval bounds what the term can add anywhere below the node.

Search. For each query a node holds the intervals of the query's terms that are not empty; its bound is the
sum of their first impacts, weighted. Nodes are opened best first, some of each query at a time so that numpy
handles all queries together; at a single document the bound is the score. Nodes that can't reach the k-th
document found so far, by score and then by doc_id, are dropped. The k best documents of a task's shards are
kept from shard to shard, so later shards begin with a high threshold. The result is exact.

Impacts depend on the corpus through the mean length, so lengths are summed before the index is written, and
document frequencies are summed over the written shards. Queries come in blocks of at most BLOCK_TERMS terms.

Defined results: null and empty texts hold no term, so they count in nothing and are never found; an item
without terms has no rows; each row of a repeated document or item stands for itself; a null doc_id comes
after all others of its score. Further columns are ignored. Terms are 64-bit hashes of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, written
from tessera.llm.textarrays import ALNUM, LOWER, spread, text_blocks, words
from tessera.session import table

K = 20
#: Bytes of text and documents of a shard; terms of the queries that are searched at once.
SHARD_BYTES, SHARD_DOCS, BLOCK_TERMS = 6 << 20, 1 << 16, 200_000
#: Nodes of each query that are opened at once.
OPENED = 16
NO_ID = 2**63 - 1
SHARD = "n long, ids binary, lengths binary, terms binary, starts binary, counts binary, levels array<binary>"


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What tf occurrences of a term add to a document of n terms, before the term's weight."""
    m = 100 - 25 + (25 * n * docs) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and their terms, of each batch."""
    for batch in batches:
        docs = total = 0
        for _, _, data, bounds in text_blocks(batch.column(0)):
            inside = ALNUM[LOWER[data]]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = bounds[(bounds > 0) & (bounds < len(data))]
            begins[edges] = inside[edges]
            n = np.diff(np.concatenate(([0], np.cumsum(begins)))[bounds])
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["docs", "total"])


def shard_row(ids: np.ndarray, lengths: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], docs: int, total: int) -> dict:
    """A shard from (document, term, tf) triples: its documents, lexicon and the tree's levels as packed bits."""
    order = np.argsort(ids, kind="stable")
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    doc, term, tf = (np.concatenate(x) for x in zip(*rows, strict=True))
    doc = number[doc]
    score = impact(tf, lengths[order][doc], docs, total)
    at = np.lexsort((doc, -score, term))
    doc, term, tf = doc[at], term[at], tf[at]
    begin = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    levels = []
    for level in reversed(range(height(len(ids)))):
        bit = (doc >> level & 1).astype(bool)
        levels.append(np.packbits(bit).tobytes())
        doc = np.concatenate((doc[~bit], doc[bit]))
    return {"n": len(ids), "ids": ids[order].astype("<i8").tobytes(), "lengths": lengths[order].astype("<u4").tobytes(), "terms": term[begin].astype("<u8").tobytes(), "starts": np.concatenate((begin, [len(term)])).astype("<u4").tobytes(), "counts": tf.astype("<u4").tobytes(), "levels": levels}


def height(n: int) -> int:
    """Levels of the tree over n documents."""
    return max(1, (n - 1).bit_length())


def _shards(docs: int, total: int, size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("ids", "lengths", "terms", "starts", "counts")), ("levels", pa.list_(pa.binary()))])
        ids, lengths, rows, seen, count = [], [], [], 0, 0
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch.column(1)):
                h, _, _, first = words(data, bounds, ALNUM)
                n = np.diff(first)
                has = np.flatnonzero(n > 0)
                if not len(has):
                    continue
                if seen and (seen + len(data) > size or count + len(has) > most):
                    yield pa.RecordBatch.from_pylist([shard_row(np.concatenate(ids), np.concatenate(lengths), rows, docs, total)], kind)
                    ids, lengths, rows, seen, count = [], [], [], 0, 0
                local = np.cumsum(n > 0) - 1 + count
                owner = np.repeat(local, n)
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))
                rows.append((owner[new], h[new], np.diff(np.concatenate((new, [len(h)])))))
                ids.append(batch.column(0).slice(a, b - a).fill_null(NO_ID).to_numpy(zero_copy_only=False)[has])
                lengths.append(n[has])
                seen, count = seen + len(data), count + len(has)
        if rows:
            yield pa.RecordBatch.from_pylist([shard_row(np.concatenate(ids), np.concatenate(lengths), rows, docs, total)], kind)

    return run


@dataclass
class Index:
    """shards: one row each; docs, total: documents that hold a term, and all their terms."""

    shards: DataFrame
    docs: int
    total: int


def build(spark: SparkSession, docs: DataFrame, size: int = SHARD_BYTES, most: int = SHARD_DOCS) -> Index:
    """The index of docs (doc_id, text), written to the shared folder."""
    small_batches(spark)
    found = docs.select("text").mapInArrow(_lengths, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    n, total = (x or 0 for x in found)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_shards(n, total, size, most), SHARD)
    return Index(written(spark, rows, "ranked-shards"), n, total)


class Shard:
    """A stored shard, ready for search: ranks and impacts of every level are derived here, once for all queries."""

    def __init__(self, row: dict, docs: int, total: int):
        self.n, self.height = row["n"], height(row["n"])
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.terms, self.starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<u4").astype(np.int64)
        tf, lengths = np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        size = len(tf)
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=size).astype(bool) for x in row["levels"]]
        doc = self._numbers(bits)
        value = impact(tf.astype(np.int64), lengths[doc], docs, total).astype(np.int32)
        #: ones before each place, and the impact at each place, level after level
        self.ones, self.value = np.zeros((self.height, size + 1), np.int32), np.empty((self.height + 1, size), np.int32)
        self.value[0] = value
        for level, bit in enumerate(bits):
            np.cumsum(bit, out=self.ones[level, 1:])
            value = np.concatenate((value[~bit], value[bit]))
            self.value[level + 1] = value
        self.zeros = size - self.ones[:, -1].astype(np.int64)

    def _numbers(self, bits: list[np.ndarray]) -> np.ndarray:
        """The document number of each posting, read down the levels."""
        at = np.arange(len(bits[0]))
        out = np.zeros(len(at), np.int64)
        for bit in bits:
            one = np.cumsum(bit)
            b = bit[at]
            out = out << 1 | b
            at = np.where(b, len(bit) - one[-1] + one[at] - 1, at - one[at])
        return out

    def frequencies(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into sorted terms, documents that hold it), of those that the shard has."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        found = np.flatnonzero(self.terms[at] == terms)
        return found, self.starts[at[found] + 1] - self.starts[at[found]]


class Best:
    """The k best (score, doc_id) of each query so far, best first."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.doc = np.zeros((queries, k), np.int64), np.full((queries, k), NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Scores are above 0; places that are still free have score 0."""
        q = np.concatenate((np.repeat(np.unique(query), self.k), query))
        u = np.unique(query)
        s, d = np.concatenate((self.score[u].ravel(), score)), np.concatenate((self.doc[u].ravel(), doc))
        order = np.lexsort((d, -s, q))
        first = np.searchsorted(q[order], u)
        top = order[(first[:, None] + np.arange(self.k))]
        self.score[u], self.doc[u] = s[top], d[top]

    def beaten(self, query: np.ndarray, bound: np.ndarray, least_doc: np.ndarray) -> np.ndarray:
        """Whether nothing of that bound, with doc_ids from least_doc on, can enter."""
        s = self.score[query, -1]
        return (bound < s) | (bound == s) & (least_doc >= self.doc[query, -1])


def search_shard(shard: Shard, query: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Enters the shard's documents for the (query, term, weight) rows, sorted by query, into best."""
    at = np.minimum(np.searchsorted(shard.terms, term), len(shard.terms) - 1)
    has = (shard.terms[at] == term) & (weight > 0)
    query, at, weight = query[has], at[has], weight[has]
    if not len(query):
        return
    # open nodes: query, level, number of the node on its level, bound; their intervals are rows begin:begin + count of (low, high, w)
    low, high, w = shard.starts[at], shard.starts[at + 1], weight
    begin = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    count = np.diff(np.concatenate((begin, [len(query)])))
    nodes = {"q": query[begin], "level": np.zeros(len(begin), np.int64), "name": np.zeros(len(begin), np.int64), "bound": np.add.reduceat(w * shard.value[0][low], begin)}
    while len(begin):
        order = np.lexsort((-nodes["bound"], nodes["q"]))
        q = nodes["q"][order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        chosen = np.zeros(len(q), bool)
        chosen[order[rank < OPENED]] = True
        picked = np.flatnonzero(chosen)
        rows = spread(begin[picked], count[picked])
        parent = np.repeat(np.arange(len(picked)), count[picked])
        level = nodes["level"][picked]
        on = level[parent]
        ones_low, ones_high = shard.ones[on, low[rows]], shard.ones[on, high[rows]]
        zeros = shard.zeros[on]
        lows, highs = np.concatenate((low[rows] - ones_low, zeros + ones_low)), np.concatenate((high[rows] - ones_high, zeros + ones_high))
        child = np.concatenate((2 * parent, 2 * parent + 1))
        filled = highs > lows
        by_child = np.flatnonzero(filled)[np.argsort(child[filled], kind="stable")]
        lows, highs, child, weights = lows[by_child], highs[by_child], child[by_child], np.concatenate((w[rows], w[rows]))[by_child]
        new_begin = np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1])))
        new_count = np.diff(np.concatenate((new_begin, [len(child)])))
        node = child[new_begin]
        below = level[node >> 1] + 1
        bound = np.add.reduceat(weights * shard.value[below[np.repeat(np.arange(len(node)), new_count)], lows], new_begin)
        fresh = {"q": nodes["q"][picked][node >> 1], "level": below, "name": nodes["name"][picked][node >> 1] << 1 | node & 1, "bound": bound}
        leaf = below == shard.height
        if leaf.any():
            doc = shard.ids[fresh["name"][leaf]]
            better = ~best.beaten(fresh["q"][leaf], bound[leaf], doc)
            if better.any():
                best.add(fresh["q"][leaf][better], bound[leaf][better], doc[better])
        kept = np.flatnonzero(~chosen)
        inner = np.flatnonzero(~leaf)
        joined = {c: np.concatenate((nodes[c][kept], fresh[c][inner])) for c in nodes}
        begins, counts = np.concatenate((begin[kept], len(low) + new_begin[inner])), np.concatenate((count[kept], new_count[inner]))
        low, high, w = np.concatenate((low, lows)), np.concatenate((high, highs)), np.concatenate((w, weights))
        alive = ~best.beaten(joined["q"], joined["bound"], shard.ids[np.minimum(joined["name"] << (shard.height - joined["level"]), shard.n - 1)])
        nodes, begin, count = {c: x[alive] for c, x in joined.items()}, begins[alive], counts[alive]
        if len(low) > 4 * int(count.sum()) + 1000:  # drop the intervals of closed nodes
            rows = spread(begin, count)
            low, high, w = low[rows], high[rows], w[rows]
            begin = np.cumsum(count) - count


@dataclass
class Block:
    """Queries of one block: row i of (query, term, occurrences) sorted by query; items are named by their place."""

    items: list
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """The queries (item_id, text) in blocks. The driver reads them one after another."""
    ids, parts, n = [], [], 0

    def made() -> Block:
        query, term, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Block(ids, query, term, times)

    for row in items.select("item_id", "text").toLocalIterator():
        raw = np.frombuffer((row["text"] or "").encode(), np.uint8)
        h = words(raw, np.array([0, len(raw)]), ALNUM)[0]
        if not len(h):
            continue
        if n and n + len(h) > most:
            yield made()
            ids, parts, n = [], [], 0
        terms, times = np.unique(h, return_counts=True)
        parts.append((np.full(len(terms), len(ids)), terms, times))
        ids.append(row["item_id"])
        n += len(h)
    if parts:
        yield made()


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = np.zeros(len(terms), np.int64)
            for row in batch.to_pylist():
                have, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(have, terms), len(have) - 1)
                df += np.where(have[at] == terms, starts[at + 1] - starts[at], 0)
            met = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], ["i", "df"])

    return run


def _search(index_docs: int, index_total: int, block: Block, weight: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.items), k)
        for batch in batches:
            for i in range(batch.num_rows):
                search_shard(Shard(batch.slice(i, 1).to_pylist()[0], index_docs, index_total), block.query, block.term, weight, best)
        q, r = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.doc[q, r]), pa.array(best.score[q, r])], ["q", "doc_id", "score"])

    return run


def search(spark: SparkSession, index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text) with a score above 0."""
    small_batches(spark)
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for block in blocks(items):
        terms = np.unique(block.term)
        counted = index.shards.select("terms", "starts").mapInArrow(_frequencies(terms), "i long, df long").groupBy("i").agg(F.sum("df").alias("df"))
        df = np.zeros(len(terms), np.int64)
        for row in counted.collect():  # at most the terms of one block
            df[row["i"]] = row["df"]
        weight = weights(df, index.docs)[np.searchsorted(terms, block.term)] * block.times
        found = index.shards.mapInArrow(_search(index.docs, index.total, block, weight, k), "q long, doc_id long, score long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.items)), f"q long, item_id {kind.simpleString()}")
        named = top.join(F.broadcast(names), "q")  # one row an item of this block
        out = out.unionByName(named.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, build(spark, table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents
), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // total) AS m FROM l, c),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""
