"""Documents packed into sequences of a fixed size by patterns of lengths, fitted with non-negative least squares.

1. Tasks turn documents into ids of a public tokenizer, with one id that ends a document, and cut documents
   that are longer than a sequence. A piece is a narrow row; its length and its place among the task's pieces
   of that length say later where it goes.
2. The driver sees the histogram of lengths: at most as many numbers as a sequence has tokens, whatever the
   corpus. Patterns are sets of up to three lengths that fill a sequence exactly; how often each is used is
   fitted to the histogram by non-negative least squares, and rounded down to what the histogram holds.
3. What is left is packed best-fit, longest first, on counts: pieces of one length go to the fullest sequences
   that take them, a group of equal sequences at a time.
4. The k-th piece of a length takes the k-th place that the patterns have for it. Places are intervals of k.

The plan's size depends on the size of a sequence only, so it is handed to the tasks as it is.

Defined results: a null or empty text is a document of the end id alone; repeated rows and null doc_ids are
documents of their own; further columns are ignored; an empty table gives no piece and no sequence. Words are
told apart by 64-bit hashes, ASCII case aside, within a worker's table of known words.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, written
from tessera.llm.textarrays import NONBLANK, spread, text_blocks, words
from tessera.session import table

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Patterns of three lengths are thinned to about so many, by taking every few middle lengths; the plan with the fewest sequences is kept.
PATTERNS = (20_000, 2_000)
STEPS = 400
#: Numbered offsets of (task, length) that may be broadcast, by a count made before; beyond it the join is a shuffle.
SMALL = 500_000
#: Words that a worker keeps with their ids.
KNOWN = 1_000_000
#: A mark that is one token between blanks.
MARK = "\x01"
#: 1 for bytes of ASCII letters and digits, 2 for those of ASCII marks but the apostrophe.
_KIND = np.array([1 if chr(b).isalnum() and b < 128 else 2 if 33 <= b < 127 and b != 39 else 0 for b in range(256)], np.uint8)
_WORKERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts. The tokenizer parts words at white space and between ASCII letters or digits and ASCII marks but the apostrophe, and lower-cases; texts are split there, and each different word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        (self.mark,) = self.ids_of(MARK)
        self.forget()

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        self.known, self.starts, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, tokens: list[bytes]) -> None:
        """Encodes new words: those of ASCII letters by the tokenizer's model, as nothing else touches them but the lower-casing, all others together, with a mark behind each."""
        ids: list[int] = []
        counts = np.zeros(len(tokens), np.int64)
        others = []
        for i, x in enumerate(tokens):
            if x.isalpha():
                found = self.model.tokenize(x.lower().decode())
                ids += [t.id for t in found]
                counts[i] = len(found)
            else:
                others.append(i)
        letters = counts > 0
        counts[others], more = self._marked([tokens[i] for i in others])
        starts = np.zeros(len(tokens), np.int64)
        starts[letters] = np.cumsum(counts[letters]) - counts[letters]
        starts[others] = len(ids) + np.cumsum(counts[others]) - counts[others]
        at = np.searchsorted(self.known, hashes)
        self.known, self.counts = np.insert(self.known, at, hashes), np.insert(self.counts, at, counts)
        self.starts = np.insert(self.starts, at, len(self.ids) + starts)
        self.ids = np.concatenate((self.ids, np.array(ids, np.uint32), more))

    def _marked(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them."""
        ids = np.array(self.ids_of(b"".join(x + b" " + MARK.encode() + b" " for x in tokens).decode()), np.uint32)
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) == len(tokens):
            return np.diff(np.concatenate(([-1], ends))) - 1, np.delete(ids, ends)
        each = [self.ids_of(x.decode()) for x in tokens]  # a word holds the mark
        return np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], np.uint32)

    def encode(self, data: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of each text, `end` behind each, and where each text begins."""
        n = len(bounds) - 1
        if b"<|" in (raw := data.tobytes()):  # special tokens, which know case and no borders
            each = [np.array([*self.ids_of(raw[a:b].decode()), end], np.uint32) for a, b in itertools.pairwise(bounds.tolist())]
            return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
        kind = _KIND[data]
        cuts = np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1
        h, starts, ends, _ = words(data, np.union1d(bounds, cuts), NONBLANK)
        first = np.searchsorted(starts, bounds)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any():
            if len(self.known) > KNOWN:
                self.forget()
                new[:] = True
            self.learn(distinct[new], [raw[starts[i] : ends[i]] for i in where[new].tolist()])
        place = np.searchsorted(self.known, distinct)
        counts = self.counts[place][back]
        total = np.concatenate(([0], np.cumsum(counts)))
        begin = total[first] + np.arange(n + 1)
        ids = np.full(int(total[-1]) + n, end, np.uint32)
        at = np.ones(len(ids), bool)
        at[begin[1:] - 1] = False
        ids[at] = self.ids[spread(self.starts[place][back], counts)]
        return ids, begin


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKERS:
            _WORKERS[path] = Encoder(path)
        encoder, part, met = _WORKERS[path], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch.column(1)):
                ids, first = encoder.encode(data, bounds, end)
                sizes = np.diff(first)
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = spread(np.zeros(b - a, np.int64), count)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = first[row] + start
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[i : i + n]) for i, n in zip(begin.tolist(), length.tolist(), strict=True)]
                # the place of each among this task's pieces of its length
                order = np.argsort(length, kind="stable")
                _, runs, many = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(runs, many)
                nth += met[length]
                met += np.bincount(length, minlength=capacity + 1)
                out = [batch.column(0).slice(a, b - a).take(pa.array(row)), piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(row), part, np.int32), nth]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [first[-1]])).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], _COLUMNS + ["ids"] * with_ids)

    return run


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the task), nth (its place among the task's pieces of this length), ids if asked for."""
    small_batches(docs.sparkSession)
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pieces(path, capacity, end, with_ids), kinds)


def patterns(lengths: list[int], capacity: int, most: int = PATTERNS[0]) -> np.ndarray:
    """Rows of three lengths, the longest first, zeros behind: all single lengths, pairs and triples among `lengths` that fill `capacity` exactly, triples thinned by their middle length."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    low = np.array([x for x in lengths if 2 * x <= capacity], np.int64)
    if len(low):
        pair = low[there[capacity - low]]
        out.append(np.stack([capacity - pair, pair, np.zeros_like(pair)], 1))
    step = max(1, math.ceil(len(lengths) ** 2 / 12 / most))
    for b in sorted(lengths)[::step]:
        c = low[low <= b]
        a = capacity - b - c
        ok = a >= b
        c, a = c[ok], a[ok]
        keep = there[a]
        out.append(np.stack([a[keep], np.full(int(keep.sum()), b), c[keep]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def least_squares(p: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes the lengths used by patterns p, x[i] times each, come close to the histogram: accelerated projected gradients on the sparse system."""
    size = len(histogram)
    if not len(p):
        return np.zeros(0)
    use = lambda x: sum(np.bincount(p[:, k], x, size) for k in range(3)) * (np.arange(size) > 0)
    back = lambda r: sum(r[p[:, k]] * (p[:, k] > 0) for k in range(3))
    probe = np.ones(len(p))
    for _ in range(20):  # the largest eigenvalue, for the step
        probe = back(use(probe))
        largest = float(np.linalg.norm(probe))
        probe /= largest
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(use(y) - histogram) / (1.05 * largest))
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


@dataclass
class Plan:
    """Groups of equal sequences: how many, and the (length, copies) that stand in each from offset 0 on."""

    groups: list[tuple[int, list[tuple[int, int]]]]

    def size(self) -> int:
        return sum(times for times, _ in self.groups)

    def places(self) -> tuple[np.ndarray, ...]:
        """Sorted by (length, first): interval of the pieces of one length, copies in a sequence, first sequence, offset."""
        rows, used, sequence = [], defaultdict(int), 0
        for times, items in self.groups:
            offset = 0
            for length, copies in items:
                rows.append((length, used[length], copies, sequence, offset))
                used[length] += times * copies
                offset += length * copies
            sequence += times
        return tuple(np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5).T)


def fitted(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Every piece of the histogram gets a place."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    return min((_fit(counts.copy(), capacity, most) for most in PATTERNS), key=Plan.size)


def _fit(left: np.ndarray, capacity: int, most: int) -> Plan:
    """The patterns by least squares, rounded down, then the rest best-fit."""
    p = patterns([int(x) for x in np.flatnonzero(left)], capacity, most)
    x = np.floor(least_squares(p, left.astype(float)) + 1e-6).astype(np.int64)
    groups = []
    for i in np.argsort(-x, kind="stable")[: int((x > 0).sum())].tolist():
        items = [(length, len(list(same))) for length, same in itertools.groupby(v for v in p[i].tolist() if v)]
        times = min(int(x[i]), *(int(left[length]) // copies for length, copies in items))
        if times:
            groups.append((times, items))
            for length, copies in items:
                left[length] -= times * copies
    return Plan(groups + best_fit(left, capacity))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pieces by length, longest first, each into the fullest sequence that takes it; equal sequences are handled together."""
    by_space: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    spaces: list[int] = []

    def put(space: int, times: int, items: list[tuple[int, int]]) -> None:
        if not by_space[space]:
            insort(spaces, space)
        by_space[space].append((times, items))

    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                space, times, items = capacity, count, []
            else:
                space = spaces[at]
                times, items = by_space[space].pop()
                if not by_space[space]:
                    spaces.pop(at)
            copies = min(space // length, count)
            full = min(times, count // copies)
            if items and times > full:
                put(space, times - full, items)
            put(space - copies * length, full, [*items, (length, copies)])
            count -= full * copies
    return [group for groups in by_space.values() for group in groups]


def _placed(places: tuple[np.ndarray, ...]):
    length, first, copies, sequence, offset = places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = length << 44 | first
        for batch in batches:
            n, k = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "k"))
            at = np.searchsorted(key, n << 44 | k, "right") - 1
            nth = k - first[at]
            out = batch.drop_columns("k")
            yield out.append_column("sequence_id", pa.array(sequence[at] + nth // copies[at])).append_column("offset", pa.array(offset[at] + nth % copies[at] * n))

    return run


def packed(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset instead of part and nth. Sequences are numbered from 0."""
    rows = written(spark, pieces(docs, path, capacity, end, with_ids), "pieces")
    each = written(spark, rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    base = F.broadcast(base) if each.count() <= SMALL else base
    numbered = rows.join(base, ["part", "length"]).withColumn("k", F.col("base") + F.col("nth")).select(*(c for c in rows.columns if c not in ("part", "nth")), "k")
    plan = fitted(histogram, capacity)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "k")
    return numbered.mapInArrow(_placed(plan.places()), f"{kinds}, sequence_id bigint, offset bigint")


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
