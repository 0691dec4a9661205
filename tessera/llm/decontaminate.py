"""Benchmark decontamination by suffix arrays over shards of the training documents.

A shard is a run of documents of about SHARD bytes. Its words become ids of the
benchmark's vocabulary, 0 for words the benchmark lacks; a suffix ends at its text's end or before
the first 0, as no match goes further, and one that ends before the shortest window is full is left out.

The array is sorted on the first WINDOW words of its suffixes. A binary search finds the interval of each benchmark
suffix's first window, and the intervals that were met are sorted on to the length of the longest
benchmark suffix that reached them; the rest of the array is never visited again and stays as it is. A second binary search places each
whole benchmark suffix in its interval. With the common lengths of neighbours in the array this gives its
longest verbatim match at every place: the words hit, the items, and each document's longest match
(ties: the first place, then the smallest item).

Tasks turn the benchmark into blocks of at most BLOCK_WORDS words (a longer item makes a block of its
own), which go to the executors as broadcasts; each shard is searched for one block after the other, so a worker holds one
block at a time. Documents do not move: the work is a map.

Defined results: null text has no words; items without words give no window; a null item_id
is written as an empty name. Rows of the benchmark that share an item_id are one item. Repeated
documents and null doc_ids give their own rows. Further columns are ignored by the report and kept by
decontaminated(). Empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import small_batches
from tessera.llm.textarrays import ALNUM, spread, text_blocks, words
from tessera.session import table

WINDOW, BLOCK_WORDS, SHARD = 10, 1_000_000, 1 << 20
REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest_match bigint, longest_item string, longest_at bigint"


def _chunks(ids: np.ndarray, at: np.ndarray, left: np.ndarray, skip: np.ndarray | int) -> np.ndarray:
    """WINDOW words of the suffixes at `at` after their first `skip`; 0 beyond the `left` words they have."""
    j = np.reshape(skip, (-1, 1)) + np.arange(WINDOW)
    return np.where(j < left[:, None], ids[np.minimum(at[:, None] + j, len(ids) - 1)], 0)


def _keys(rows: np.ndarray, pad: bytes = b"\0") -> np.ndarray:
    """Rows of word ids as byte strings of the same order, zeros as `pad`."""
    out = np.where(rows == 0, -1 if pad == b"\xff" else 0, rows).astype(">i4")
    return np.ascontiguousarray(out).view(f"S{4 * WINDOW}").ravel()


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that two rows have in common from the left, ends (0) not counted."""
    return np.cumprod((a == b) & (a != 0), axis=1).sum(1)


class Block:
    """Suffixes of some benchmark items, grouped by their first window."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in items)])
        self.vocabulary = np.unique(hashes)
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.ids = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        size = np.array([len(h) for _, h in items], np.int64)
        window = np.minimum(size, WINDOW)
        first = np.cumsum(size) - size
        each = size - window + 1
        at, end, length = spread(first, each), np.repeat(first + size, each), np.repeat(window, each)
        owner = np.repeat(np.array([number[name] for name, _ in items], np.int64), each)
        rows = _chunks(self.ids, at, length, 0) if len(at) else np.zeros((0, WINDOW), np.int32)
        low, high = _keys(rows), _keys(rows, b"\xff")
        order = np.lexsort((length, low))
        low, high, length = low[order], high[order], length[order]
        #: Of each suffix its start in ids, the words from there to the item's end, and its item.
        self.at, self.left, self.owner = at[order], (end - at)[order], owner[order]
        new = np.concatenate((np.ones(min(1, len(low)), bool), (low[1:] != low[:-1]) | (length[1:] != length[:-1])))
        #: Suffixes first[k]:first[k + 1] begin with the k-th window, from low[k] to high[k] as keys.
        self.first = np.append(np.flatnonzero(new), len(low))
        self.low, self.high, self.length = low[new], high[new], length[new]
        self.least = int(length.min()) if len(length) else 0

    def __getstate__(self) -> dict:
        """Without the keys, which are two thirds of a block and follow from the first windows."""
        return {k: v for k, v in self.__dict__.items() if k not in ("low", "high")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        rows = _chunks(self.ids, self.at[self.first[:-1]], self.length, 0) if len(self.length) else np.zeros((0, WINDOW), np.int32)
        self.low, self.high = _keys(rows), _keys(rows, b"\xff")


def _made(rows: Iterator[tuple[str, str]], size: int) -> Iterator[Block]:
    """Blocks of at most `size` words, or of one item, from (item, text)."""
    items, n = [], 0
    for name, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h = words(raw, np.array([0, len(raw)]), ALNUM)[0]
        if not len(h):
            continue
        if items and n + len(h) > size:
            yield Block(items)
            items, n = [], 0
        items.append((name or "", h))
        n += len(h)
    if items:
        yield Block(items)


def blocks(spark: SparkSession, benchmark: DataFrame, size: int = BLOCK_WORDS) -> list[Broadcast]:
    """The benchmark's items as broadcast blocks, made by tasks; the driver hands them on partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _made((row for batch in batches for row in zip(*map(pa.Array.to_pylist, batch.columns), strict=True)), size):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    made = benchmark.selectExpr("cast(item_id AS string) AS item_id", "text").mapInArrow(run, "block binary")
    return [spark.sparkContext.broadcast(pickle.loads(r["block"])) for r in made.toLocalIterator()]


class Suffixes:
    """The suffix array of a shard: `at` are the suffixes in order of their first WINDOW words, `left` their words."""

    def __init__(self, ids: np.ndarray, stop: np.ndarray, least: int):
        """stop: the end of each position's text."""
        n = len(ids)
        self.ids = ids
        free = np.minimum(np.minimum.accumulate(np.where(ids == 0, np.arange(n), n)[::-1])[::-1], stop) - np.arange(n)
        at = np.flatnonzero(free >= least)
        keys = _keys(_chunks(ids, at, free[at], 0))
        order = np.argsort(keys, kind="stable")
        self.at, self.keys = at[order], keys[order]
        self.left = free[self.at]
        #: Common words of a suffix with the one before it, for those within an interval that order() sorted.
        self.common = np.zeros(len(at), np.int64)

    def order(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> None:
        """Sorts the disjoint intervals lo:hi, each of one first window, by their suffixes' first `depth` words."""
        where = spread(lo, hi - lo)
        group, depth = np.repeat(lo, hi - lo), np.repeat(depth, hi - lo)
        self.common[where] = np.minimum(self.left[where], depth)
        skip = WINDOW
        while True:
            # a group goes on while it has several suffixes, is not deep enough and holds a suffix that has not ended
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.append(start, len(group)))
            open_ = np.repeat((size > 1) & (depth[start] > skip) & (np.maximum.reduceat(self.left[where], start) > skip), size)
            where, group, depth = where[open_], group[open_], depth[open_]
            if not len(where):
                return
            rows = _chunks(self.ids, self.at[where], self.left[where], skip)
            keys = _keys(rows)
            by = np.lexsort((keys, group))  # groups are runs of `where` and stay in their place
            self.at[where], self.left[where], rows, keys = self.at[where][by], self.left[where][by], rows[by], keys[by]
            same = np.r_[False, group[1:] == group[:-1]]
            parted = np.flatnonzero(same & np.r_[False, keys[1:] != keys[:-1]])
            self.common[where[parted]] = np.minimum(skip + _equal(rows[parted - 1], rows[parted]), depth[parted])
            ended = np.flatnonzero(same & np.r_[False, keys[1:] == keys[:-1]])
            self.common[where[ended]] = np.minimum(self.left[where[ended]], depth[ended])
            new = np.r_[True, ~same[1:] | (keys[1:] != keys[:-1])]
            group = where[np.flatnonzero(new)][np.cumsum(new) - 1]
            skip += WINDOW

    def place(self, block: Block, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Binary search of benchmark suffixes in their sorted intervals: where each belongs, and its common words with the neighbours on the left and right."""
        lo, hi = lo.copy(), hi.copy()
        left, right = np.full(len(lo), WINDOW), np.full(len(lo), WINDOW)
        busy = np.flatnonzero(lo < hi)
        while len(busy):
            mid = (lo[busy] + hi[busy]) // 2
            known = np.minimum(left[busy], right[busy])
            less = np.zeros(len(busy), bool)
            go = np.arange(len(busy))
            while len(go):
                mine = _chunks(block.ids, block.at[suffix[busy[go]]], block.left[suffix[busy[go]]], known[go])
                other = _chunks(self.ids, self.at[mid[go]], self.left[mid[go]], known[go])
                n = _equal(mine, other)
                known[go] += n
                here = np.flatnonzero(n < WINDOW)
                less[go[here]] = other[here, n[here]] < mine[here, n[here]]
                go = go[n == WINDOW]
            up, down = busy[less], busy[~less]
            lo[up], left[up] = mid[less] + 1, known[less]
            hi[down], right[down] = mid[~less], known[~less]
            busy = busy[lo[busy] < hi[busy]]
        return lo, left, right


def _falling(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running minimum of each run of `counts` values; values are below 2**40."""
    run = np.repeat(np.arange(len(counts), 0, -1), counts) << 40
    return np.minimum.accumulate(values + run) - run


class Found:
    """Matches of one shard: hit words, (document, item) pairs, longest match of each document."""

    def __init__(self, n_words: int, n_docs: int):
        self.hit = np.zeros(n_words + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(n_docs)]
        #: (-words, place, item), the smallest of a document.
        self.longest: list[tuple[int, int, str]] = [(0, 0, "")] * n_docs

    def search(self, block: Block, h: np.ndarray, first: np.ndarray) -> None:
        if not len(block.low) or not len(h):
            return
        at = np.searchsorted(block.vocabulary, h)
        at[at == len(block.vocabulary)] = 0
        ids = np.where(block.vocabulary[at] == h, at + 1, 0).astype(np.int32)
        doc = np.searchsorted(first, np.arange(len(h)), "right") - 1
        array = Suffixes(ids, first[doc + 1], block.least)
        if not len(array.at):
            return
        lo, hi = np.searchsorted(array.keys, block.low, "left"), np.searchsorted(array.keys, block.high, "right")
        met = hi > lo
        full = np.flatnonzero(met & (block.length == WINDOW))
        short = np.flatnonzero(met & (block.length < WINDOW))
        parts = []
        if len(full):
            array.order(lo[full], hi[full], np.maximum.reduceat(block.left, block.first[:-1])[full])
            behind = block.first[full + 1] - block.first[full]
            suffix, lo_, hi_ = spread(block.first[full], behind), np.repeat(lo[full], behind), np.repeat(hi[full], behind)
            p, left, right = array.place(block, suffix, lo_, hi_)
            for there, n, one, way in ((p, hi_ - p, right, 1), (p - 1, p - lo_, left, -1)):
                k = np.flatnonzero(n)
                step = spread(np.zeros(len(k), np.int64), n[k])
                entry = np.repeat(there[k], n[k]) + way * step
                words_ = _falling(np.where(step == 0, np.repeat(one[k], n[k]), array.common[np.clip(entry + (way < 0), 0, len(array.at) - 1)]), n[k])
                parts.append((array.at[entry], np.repeat(suffix[k], n[k]), words_))
        if len(short):  # an item below a window's length: the interval holds all its places
            behind = block.first[short + 1] - block.first[short]
            suffix, n = spread(block.first[short], behind), np.repeat(hi[short] - lo[short], behind)
            entry, suffix = spread(np.repeat(lo[short], behind), n), np.repeat(suffix, n)
            parts.append((array.at[entry], suffix, block.left[suffix]))
        if parts:
            self._add(block, doc, first, *map(np.concatenate, zip(*parts, strict=True)))

    def _add(self, block: Block, doc: np.ndarray, first: np.ndarray, pos: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.hit, pos, 1)
        np.add.at(self.hit, pos + n, -1)
        where, owner = doc[pos], block.owner[suffix]
        for d, k in np.unique(np.stack((where, owner)), axis=1).T.tolist():
            self.items[d].add(block.names[k])
        order = np.lexsort((owner, pos, -n, where))
        for k in order[np.r_[True, np.diff(where[order]) != 0]].tolist():
            d = int(where[k])
            self.longest[d] = min(self.longest[d], (-int(n[k]), int(pos[k] - first[d]), block.names[owner[k]]))


def shard_report(column: pa.Array, held: list[Broadcast]) -> Iterator[tuple]:
    """REPORT's values but doc_id for each text of a column."""
    for _, _, data, bounds in text_blocks(column, SHARD):
        h, _, _, first = words(data, bounds, ALNUM)
        found = Found(len(h), len(bounds) - 1)
        for b in held:
            found.search(b.value, h, first)
            if len(held) > 1:
                b.__dict__.pop("_value", None)  # read again from the broadcast's file when the next shard needs it
        hit = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.cumsum(found.hit[:-1]) > 0)))
        for d in range(len(bounds) - 1):
            n, items = int(hit[first[d + 1]] - hit[first[d]]), sorted(found.items[d])
            length, at, item = found.longest[d]
            yield int(first[d + 1] - first[d]), n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0, -length, item if length else None, at if length else None


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """REPORT: a row for each document."""
    small_batches(spark)
    held = blocks(spark, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in REPORT.split(", ")]
        for batch in batches:
            if batch.num_rows:
                made = list(zip(*shard_report(batch.column(1), held), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names)

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, REPORT)


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the affected documents; all columns stay as they are."""
    small_batches(spark)
    held = blocks(spark, benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shard_report(batch.column(batch.schema.get_field_index("text")), held)
            yield batch.filter(pa.array([not r[4] for r in made], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Windows of ten words by a moving string_agg; items of fewer words meet any position by comparing prefixes of that string.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, j, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) || ' ' AS s
       FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d)),
bw AS (SELECT item_id, n, j, string_agg(x, ' ') OVER (PARTITION BY r ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) || ' ' AS s
       FROM (SELECT item_id, r, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM b)),
win AS (SELECT DISTINCT item_id, least(n, {WINDOW}) AS k, s FROM bw WHERE j = 1 OR j <= n - {WINDOW - 1}),
ks AS (SELECT DISTINCT k FROM win),
occ AS (SELECT doc_id, j, k, CASE WHEN k = {WINDOW} THEN s ELSE array_to_string(list_slice(string_split(s, ' '), 1, k), ' ') || ' ' END AS s FROM dw, ks),
hit AS (SELECT doc_id, j, k, item_id FROM occ JOIN win USING (k, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
