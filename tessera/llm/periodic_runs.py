"""Periodic runs of words, by Kolpakov and Kucherov's algorithm.

A run is a stretch of words with smallest period q and a length of at least max(LEAST, 2 * q) that no
neighbouring word extends with period q. For each text

1. only stretches that can hold runs are looked at: within a run each word lies in a window of LEAST // 2
   words that occurs twice in the run, so a text is cut to the stretches of such windows, and these again by
   windows that occur twice in one stretch. This is exact: no run reaches over the end of a stretch.
2. a suffix automaton of the stretch gives its Lempel-Ziv factors: each the longest prefix of the rest that
   begins earlier too, or a new word.
3. Main's algorithm finds the runs that cross or touch the border between two factors from the longest
   extensions of every period to both sides.
4. all other runs lie strictly inside one factor and are copied, in order of their starts, from the factor's
   earlier occurrence.

Steps 2 to 4 run on arrays and small tables of one stretch, so memory follows the longest text of a worker.

Defined results: a null or empty text has no words, no runs and the empty collapsed text; repeated rows each
give a row; a null doc_id is kept as null (and is never rewritten by the query). Further columns of the
documents are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.native import let, whole
from tessera.llm.shared import small_batches
from tessera.llm.textarrays import NONBLANK, mixed, text_blocks, words
from tessera.session import table

LEAST = 12
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_AS_IS = np.arange(256, dtype=np.uint8)
_PLACE = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The cutting into stretches is repeated this often at most; it saves work only.
ROUNDS = 8


def stretches(h: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of words that can hold runs of `least` words and more; texts are h[first[i]:first[i + 1]]."""
    k, n = least // 2, len(h)
    if n < least:
        return []
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    windows = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        windows += h[j : n - k + 1 + j] * _PLACE[j]
    at = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    group = owner.astype(np.uint64)
    for _ in range(ROUNDS):
        keys = mixed(windows[at]) ^ mixed(group[at] + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        kept = at[twice]
        edge = np.bincount(kept, minlength=n + 1)[: n + 1] - np.bincount(kept + k, minlength=n + 1)[: n + 1]
        inside = np.cumsum(edge)[:n] > 0
        new = inside & (np.concatenate(([True], ~inside[:-1])) | np.concatenate(([True], owner[1:] != owner[:-1])))
        group = np.cumsum(new).astype(np.uint64)
        ok = kept[group[kept] == group[kept + k - 1]]
        if len(ok) == len(at):
            break
        at = ok
    starts = np.flatnonzero(new)
    last = inside & (np.concatenate((~inside[1:], [True])) | np.concatenate((owner[1:] != owner[:-1], [True])))
    ends = np.flatnonzero(last) + 1
    long = ends - starts >= least
    return list(zip(owner[starts[long]].tolist(), starts[long].tolist(), ends[long].tolist(), strict=True))


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence or -1) of the Lempel-Ziv factors, occurrences may overlap; from the suffix automaton of w.

    A state keeps its first edge in two lists, further edges in a table of its own, as most states have one.
    """
    link, size, ends, word, to = [-1], [0], [-1], [-1], [-1]
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(w):
        new = len(size)
        size.append(size[last] + 1)
        ends.append(i)
        link.append(0)
        word.append(-1)
        to.append(-1)
        p, q = last, -1
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = c, new
            elif p not in more:
                more[p] = {c: new}
            elif (q := more[p].get(c, -1)) >= 0:
                break
            else:
                more[p][c] = new
            p = link[p]
        last = new
        if p < 0:
            continue
        if size[p] + 1 == size[q]:
            link[new] = q
            continue
        copy = len(size)
        size.append(size[p] + 1)
        ends.append(ends[q])
        link.append(link[q])
        word.append(word[q])
        to.append(to[q])
        if q in more:
            more[copy] = more[q].copy()
        while p >= 0:
            if word[p] == c:
                if to[p] != q:
                    break
                to[p] = copy
            elif p in more and more[p].get(c) == q:
                more[p][c] = copy
            else:
                break
            p = link[p]
        link[q] = link[new] = copy
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            c = w[j]
            following = to[state] if word[state] == c else more[state][c] if state in more else -1
            if following < 0 or ends[following] >= j:
                break
            state, j = following, j + 1
        if j == i:
            out.append((i, 1, -1))
            i += 1
        else:
            out.append((i, j - i, ends[state] - (j - i) + 1))
            i = j
    return out


def _prefixes(s: list[int], size: int) -> list[int]:
    """For each i the length of the longest common prefix of s and s[i:], for i < size (Z-function)."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, size):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(w: list[int], b: int, left: int, right: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions within w[left:right] that hold a whole period next to the border b, on either side of it (Main)."""
    x, y = w[left:b], w[b:right]
    m, n = len(x), len(y)
    forward, backward = _prefixes(y, n), _prefixes(x[::-1], m)
    to_right = _prefixes([*y, -1, *x, *y], n + 1 + m)  # of y with (x + y)[i:], at n + 1 + i
    to_left = _prefixes([*x[::-1], -1, *y[::-1], *x[::-1]], m + 1 + n)  # of x, backwards, with the ends of x + y
    for p in range(1, n + 1):
        ahead = forward[p] if p < n else 0
        before = min(to_left[m + 1 + n - p], m)
        if before + ahead >= p and before + ahead + p >= least:
            yield b - before, b + p + ahead, p
    for p in range(1, m + 1):
        before = backward[p] if p < m else 0
        ahead = min(to_right[n + 1 + m - p], n)
        if before + ahead >= p and before + ahead + p >= least:
            yield b - p - before, b + ahead, p


def runs_of(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of w with at least `least` words, by start, then period."""
    n = len(w)
    lz = factors(w)
    found: dict[tuple[int, int], int] = {}
    for (_, before, _), (b, size, _) in itertools.pairwise([*lz, (n, 0, -1)]):
        # a run that ends in the factor at b begins less than 2 * before + size words ahead of it
        if 2 * (before + size) < least:
            continue
        for s, e, p in crossing(w, b, max(0, b - 2 * before - size), b + size, least):
            if (s == 0 or w[s - 1] != w[s - 1 + p]) and (e == n or w[e] != w[e - p]) and found.get((s, e), n) > p:
                found[s, e] = p
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (s, e), p in found.items():
        by_start.setdefault(s, []).append((e, p))
    for b, size, earlier in lz:
        if earlier < 0 or size < least + 2:
            continue
        shift = b - earlier
        # where the occurrence overlaps the factor, copies become originals on the way
        for s in range(earlier + 1, earlier + size - 1):
            for e, p in by_start.get(s, ()):
                if e < earlier + size and (s + shift, e + shift) not in found:
                    found[s + shift, e + shift] = p
                    by_start.setdefault(s + shift, []).append((e + shift, p))
    return sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= least)


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in text_blocks(batch.column(1)):
                h, _, _, first = words(data, bounds, NONBLANK, _AS_IS)
                by_text: dict[int, list[tuple[int, int, int]]] = {}
                for i, a, b in stretches(h, first, least):
                    distinct = np.unique(h[a:b], return_inverse=True)[1].tolist()
                    by_text.setdefault(i, []).extend((a - int(first[i]) + s, n, p) for s, n, p in runs_of(distinct, least))
                texts, found = [], []
                for i in range(end - begin):
                    tokens = data[bounds[i] : bounds[i + 1]].tobytes().split()
                    mine = sorted(by_text.get(i, ()), key=lambda r: (r[0], r[2]))
                    if mine:
                        edge = np.zeros(len(tokens) + 1, np.int64)
                        for s, n, p in mine:
                            edge[s + p] += 1
                            edge[s + n] -= 1
                        tokens = [tokens[j] for j in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    texts.append(b" ".join(tokens).decode())
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (by start, then period), collapsed: the words that no run holds after its first period, joined by blanks."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_runs(least), f"doc_id bigint, runs array<{RUN}>, collapsed string")


def rewritten(text: Column, doc_id: Column) -> Column:
    """The text of a document whose number asks for a repetition: from word a on, words repeat with a period p that both follow from the number and the count of words."""
    code = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(code / 10)

    def repeated(tokens: Column) -> Column:
        n = F.size(tokens)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.element_at(tokens, (i + 1).cast("int"))), " ")).otherwise(text)

    return F.when(code % 10 == 0, let(F.regexp_extract_all(whole(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), repeated)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", rewritten(F.col("text"), F.col("doc_id")).alias("text"))
    rows = periodic_runs(docs)
    longest = F.reduce("runs", F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
