"""Near-duplicate components by a chosen-path set similarity join.

Every document is a set of word shingles; equal sets become one class, and classes are joined. In each of
several independent trees a node holds the classes that agree on the minwise tokens chosen on the path to it;
every tree and every depth has a token of its own. A node of at most LEAF classes is compared exhaustively.
The classes of a larger node branch by the next token, DEPTH times at most. The number of trees follows from
the similarity: a pair meets at depth d of a tree with probability s**d, so even if all its nodes are large
it is missed by all trees with a probability below MISS; a pair in small nodes meets at the first depth.

Only connectivity is asked for, so large nodes link as they branch: each compares its classes with one hub,
which joins a crowd of near copies into one component, and from then on only pairs across components count.
A node that is still large at the last depth is compared in the same way: its members outside its largest
component with all, where these are MINOR at most. The classes of any other such
node go through an exact prefix-filter join: in the order of rising frequency among them, two
similar sets share one of the first n - ceil(percent * n / 100) + 1 shingles. Classes with such a
shingle in common make a node again, and there all pairs across components are compared, so nothing
is capped and no large node adds to the miss probability. These pairs are made in slices of about PAIRS, and
each slice's links are joined before the next is made.

A pair of last nodes of several trees is compared in the first of them. Comparing a pair starts with sizes and with parities, a bitmap of PARITY bits that holds whether an odd
number of shingles fell on each bit: two sets differ in at least as many shingles as their parities
in bits, so this drops pairs without an error. What passes is confirmed on full shingle sets, which
are made only for classes of such pairs and of nodes that are large at the last depth.

Groups of exact copies are one class; hubs of large groups meet their members in sort-merge joins that
Spark can split; components come from alternating large-star and small-star steps on written tables.

Defined results: without words the set is empty and the document is alone. Null doc_ids are never the
smallest of a component unless it has no other; kept is doc_id <=> component_id, so repeated rows of
one doc_id share their fate. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import forget, small_batches, text_hash, written
from tessera.llm.textarrays import NONBLANK, mixed, text_blocks, words
from tessera.session import table

DEPTH, LEAF, MISS = 3, 32, 1e-5
MINOR, PARITY = 2048, 1024
#: Pairs of large nodes that are made at once, about.
PAIRS = 100_000_000
#: Classes whose keys may be broadcast, by a count made before; beyond it the join is a shuffle.
SMALL = 500_000
#: Rows of links, or of nodes to look up, that are small enough for one partition or one broadcast table of several columns, by a bound known before.
FEW = 200_000
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 1024, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct hashes of the k-word shingles of each text, block by block; with fewer words the whole sequence is one."""
    for _, _, data, bounds in text_blocks(column):
        h, _, _, first = words(data, bounds, NONBLANK)
        out = []
        runs = np.zeros(0, np.uint64)
        if len(h) >= k:
            runs = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                runs += h[j : len(h) - k + 1 + j] * _PLACE[j]
            runs = mixed(runs + np.uint64(k))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(runs[a : b - k + 1]))
            elif b > a:
                out.append(mixed((h[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield out


def trees(percent: int, miss: float = MISS) -> int:
    """Trees after which a pair of that similarity, in large nodes at every depth, is missed with a probability of at most `miss`."""
    return min(len(_MUL) // DEPTH, max(1, math.ceil(math.log(miss) / math.log1p(-min(0.999, (percent / 100) ** DEPTH)))))


def minwise(sets: list[np.ndarray], count: int) -> np.ndarray:
    """`count` minwise values (uint32) of each set; sets must not be empty."""
    x = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), count), np.uint32)
    for i in range(count):
        out[:, i] = np.minimum.reduceat((x * _MUL[i] + _ADD[i]) >> np.uint64(32), starts)
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits as int64 words."""
    return np.packbits((np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def class_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(k: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(2), k):
                full = [s for s in sets if len(s)]
                sig = iter(minwise(full, count)) if full else iter(())
                rows = [(len(s), class_key(s), next(sig).astype(">u4").tobytes(), parity(s)) if len(s) else (0, None, None, None) for s in sets]
                n, key, sketch, par = zip(*rows, strict=True)
                columns = [batch.column(0).slice(at, len(sets)), batch.column(1).slice(at, len(sets)), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pa.array(par, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n", "key", "sig", "par"])
                at += len(sets)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in shingle_sets(batch.column(0), k):
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([class_key(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["key", "members"])

    return run


def components(spark: SparkSession, links: DataFrame, most: int | None = None) -> DataFrame:
    """(rid, root) for every end of links (a, b): root is the smallest id that can be reached. `most` links at most, where known: FEW stay in one partition, so no step of theirs is a shuffle."""
    near = lambda df: df.coalesce(1) if most is not None and most <= FEW else df
    e = near(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y")).distinct()
    e, before = written(spark, e, "edges", most), None
    while True:
        both = near(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = near(large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))).distinct()
        old, e = e, written(spark, small, "edges", most)
        forget(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())
        if now == before:
            out = written(spark, near(e).groupBy("x").agg(F.min("y").alias("root")).select(F.col("x").alias("rid"), "root"), "components", most)
            forget(e)
            return out
        before = now


class Join:
    """One run of the chosen-path join over written tables."""

    def __init__(self, spark: SparkSession, docs: DataFrame, shingle: int, percent: int):
        small_batches(spark)
        self.spark, self.percent, self.trees = spark, percent, trees(percent)
        # a row's text is named by doc_id and a 64-bit hash, so a clash of hashes matters only within one doc_id
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash("text").alias("th"), "text")
        self.docs = written(spark, rows.mapInArrow(_sketch(shingle, self.trees * DEPTH), "doc_id bigint, th bigint, n bigint, key binary, sig binary, par array<bigint>"), "sketches")
        count = self.docs.count()
        reps = self.docs.where("n > 0").groupBy("key").agg(F.first("sig").alias("sig"), F.first("par").alias("par"), F.min("n").alias("n"), F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("th"), F.min("doc_id").alias("doc_id"))
        self.reps = written(spark, reps.select(F.monotonically_increasing_id().alias("rid"), "*"), "classes", count)
        self.comps, self.linked = None, 0
        nodes = self.branches(count)
        large = [x.where((F.col("c") > LEAF) & (F.col("rid") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("rid").alias("b")) for x in nodes]
        hubs = self.candidates(large, sum(x.count() for x in large))
        # nodes of different depths have different names, so all leaves are compared in one pass
        small = reduce(DataFrame.unionByName, [x.where(F.col("c") <= LEAF).select("h", "rid", "n") for x in nodes])
        count = small.count()
        leaves = written(spark, self.within(small, False, count <= FEW).distinct(), "leaves", count)
        last = nodes.pop()
        ends = [x.select(F.explode(F.array("a", "b")).alias("rid")) for x in (hubs, leaves)] + [last.where(F.col("c") > LEAF).select("rid")]
        self.make_sets(rows, reduce(DataFrame.unionByName, ends), sum(x.count() for x in ends), shingle)
        forget(*nodes)
        self.confirm(hubs, True)
        self.confirm(self.apart(leaves), True)
        forget(hubs, leaves)
        self.finish(last)

    def token(self, sig: Column | str, t: Column | str, depth: int = 0, count: int = 1) -> Column:
        """`count` tokens of tree t from `depth` on."""
        at = F.col(t) if isinstance(t, str) else t
        return F.substring(sig, at * (4 * DEPTH) + (4 * depth + 1), F.lit(4 * count))

    def branches(self, count: int) -> list[DataFrame]:
        """(h, rid, n, t, c, hub) for each depth: members of the nodes that hold two classes or more. The root of a tree branches whole, other nodes where they are large."""
        out: list[DataFrame] = []
        for depth in range(DEPTH):
            if out:
                above = out[-1].where(F.col("c") > LEAF).select("h", "rid", "n", "t")
                rows = above.count()
                above = self.reps.select("rid", "sig").join(F.broadcast(above) if rows <= FEW else above, "rid")
                path = F.xxhash64("h", self.token("sig", "t", depth))
            else:
                above = self.reps.select("rid", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("t"))
                path, rows = F.xxhash64("t", self.token("sig", "t")), count * self.trees
            out.append(self.gathered(above.select(path.alias("h"), "rid", "n", "t"), rows))
        return out

    def finish(self, last: DataFrame) -> None:
        """Links within the nodes that are large at the last depth."""
        large = last.where(F.col("c") > LEAF)
        nodes = self.open_nodes(large)
        if nodes.isEmpty():
            forget(last, nodes)
            return
        self.compare(nodes.where(F.col("minor") <= MINOR))
        rest = written(self.spark, nodes.where(F.col("minor") > MINOR).select("rid").distinct(), "crowds")
        forget(last, nodes)
        if not rest.isEmpty():
            shared = self.sharing(rest)
            links = shared.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b"))
            self.confirm(self.candidates([links], links.count()), True)
            nodes = self.open_nodes(shared)
            forget(shared)
            self.compare(nodes)
            forget(nodes)
        forget(rest)

    def compare(self, nodes: DataFrame) -> None:
        """Links across components within nodes: leaves whole, larger ones slice by slice."""
        if nodes.isEmpty():
            return
        self.confirm(self.within(nodes.where(F.col("c") <= LEAF), True))
        large = nodes.where(F.col("c") > LEAF)
        bound, rare = large.where("rare").agg(F.sum("c"), F.count(F.lit(1))).first()
        slices = -(-(bound or 0) // PAIRS)
        for k in range(slices):
            found = self.across(large, F.pmod(F.xxhash64("rid"), F.lit(slices)) == k, rare <= FEW // 10)
            self.confirm(self.apart(found) if k else found)

    def sharing(self, active: DataFrame) -> DataFrame:
        """(h, rid, n, t (null), c, hub): classes of active that share a shingle of their prefixes; every similar pair of them meets. Shingles of one class only come first and never meet."""
        sets = self.sets.join(active, "rid", "left_semi")
        each = sets.select("rid", F.size("members").cast("bigint").alias("n"), F.explode("members").alias("h"))
        often = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        ordered = each.join(often, "h").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("m"))
        length = F.col("n") - F.floor((self.percent * F.col("n") + 99) / 100) + 1 - (F.col("n") - F.size("m"))
        prefix = F.slice("m", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
        rows = written(self.spark, ordered.select(F.explode(prefix).alias("x"), "rid", "n").select("x.h", "rid", "n", F.lit(None).cast("int").alias("t")), "prefixes")
        out = self.gathered(rows, rows.count())
        forget(rows)
        return out

    def gathered(self, rows: DataFrame, most: int) -> DataFrame:
        """rows (most at most) with the size and the hub of their node, without those that are alone in it."""
        sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("h", "rid").alias("x"), "rid"))["rid"].alias("hub")).where("c > 1")
        return written(self.spark, rows.join(F.broadcast(sizes) if most <= FEW else sizes, "h"), "nodes", most)

    def make_sets(self, rows: DataFrame, met: DataFrame, most: int, shingle: int) -> None:
        """Full sets of the classes (rid) in met, which has `most` rows with repeats, from one text of each."""
        met = F.broadcast(met) if most <= SMALL else met.distinct()
        wanted = written(self.spark, self.reps.join(met, "rid", "left_semi").select("rid", "key", "doc_id", "th"), "met", most)
        count = wanted.count()
        keys = wanted.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"))
        keys = F.broadcast(keys) if count <= SMALL else keys
        texts = rows.join(keys, (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").dropDuplicates(["doc_id", "th"]).select("text")
        made = texts.mapInArrow(_sets(shingle), "key binary, members array<bigint>")
        names = wanted.select("rid", "key")
        self.sets = written(self.spark, made.join(F.broadcast(names) if count <= FEW else names, "key").select("rid", "members"), "sets", 20 * count)
        forget(wanted)

    def may_link(self, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
        """False only for pairs that cannot reach the similarity: 100 * common >= percent * (n1 + n2 - common)."""
        common = F.ceil(self.percent * (n1 + n2) / (100 + self.percent) - 1e-9)
        differing = sum((F.bit_count(p1[i].bitwiseXOR(p2[i])) for i in range(PARITY // 64)), F.lit(0))  # no lambda, so joins evaluate it in generated code
        return F.when(100 * F.least(n1, n2) < self.percent * F.greatest(n1, n2), F.lit(False)).otherwise(differing <= n1 + n2 - 2 * common)

    def met_before(self, sig1: Column, sig2: Column, t: Column) -> Column:
        """Whether two members of a last node of tree t share one of an earlier tree too: there they are compared, or handed to the prefix join, so a pair needs one row only."""
        path = lambda sig, k: F.substring(sig, k * (4 * DEPTH) + 1, F.lit(4 * DEPTH))
        return F.when(t > 0, F.exists(F.sequence(F.lit(0), t - 1), lambda k: path(sig1, k) == path(sig2, k))).otherwise(F.lit(False))

    def candidates(self, pairs: list[DataFrame], most: int) -> DataFrame:
        """The different pairs (a, b), of `most` with repeats, that may link, written."""
        pairs = reduce(DataFrame.unionByName, pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        short = lambda x: self.reps.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("par").alias(f"p_{x}"))
        pairs = short("a").join(F.broadcast(pairs) if most <= FEW else pairs, "a").join(short("b"), "b").where(self.may_link(F.col("n_a"), F.col("p_a"), F.col("n_b"), F.col("p_b"))).select("a", "b")
        return written(self.spark, pairs, "pairs", most)

    def roots(self) -> DataFrame:
        """(rid, root) by now, broadcast where these are few."""
        return F.broadcast(self.comps) if self.linked <= SMALL else self.comps

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components by now."""
        root = lambda x: self.roots().select(F.col("rid").alias(x), F.col("root").alias(f"r_{x}"))
        both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return both.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")

    def confirm(self, pairs: DataFrame, different: bool = False) -> None:
        """Finds the pairs (a, b) that are similar on their full sets, and joins components anew. Pairs may link; whether they are known to be different."""
        pairs = pairs.select("a", "b")
        pairs = written(self.spark, pairs if different else pairs.distinct(), "confirm")
        count = pairs.count()
        if not count and self.comps is not None:
            forget(pairs)
            return
        side = lambda x: self.sets.select(F.col("rid").alias(x), F.col("members").alias(f"m_{x}"))
        met = F.broadcast(pairs) if count <= SMALL else pairs
        ends = met.select("b") if count <= SMALL else met.select("b").distinct()
        both = side("a").join(met, "a").join(side("b").join(ends, "b", "left_semi"), "b")
        common, total = F.size(F.array_intersect("m_a", "m_b")).cast("bigint"), (F.size("m_a") + F.size("m_b")).cast("bigint")
        found = written(self.spark, both.select("a", "b", common.alias("c"), total.alias("n")).where(100 * F.col("c") >= self.percent * (F.col("n") - F.col("c"))).select("a", "b"), "links", 20 * count)
        old = self.comps
        if old is None:
            self.linked = count
            self.comps = components(self.spark, found, count)
        elif (new := found.count()):
            # a component has fewer rows than links, as its root has none
            self.linked += new
            self.comps = components(self.spark, found.unionByName(old.select(F.col("rid").alias("a"), F.col("root").alias("b"))), self.linked)
            forget(old)
        forget(pairs, found)

    def rooted(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.roots(), "rid", "left").withColumn("root", F.coalesce("root", "rid"))

    def open_nodes(self, nodes: DataFrame) -> DataFrame:
        """Members, with roots and parities, of the nodes that hold more than one component; minor: members outside the largest one, rare: whether this is such a member."""
        count = nodes.count()
        rows = self.rooted(nodes)
        sizes = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"))
        most = sizes.groupBy("h").agg(F.sum("k").alias("all"), F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        most = most.select("h", (F.col("all") - F.col("top.k")).alias("minor"), F.col("top.root").alias("major"))
        rows = rows.join(F.broadcast(most) if count <= FEW else most, "h").withColumn("rare", F.col("root") != F.col("major")).drop("major")
        return written(self.spark, self.reps.select("rid", "par", "sig").join(F.broadcast(rows) if count <= FEW else rows, "rid"), "open", count)

    def within(self, leaves: DataFrame, opened: bool, few: bool = False) -> DataFrame:
        """Pairs (a, b) that may link within leaves, from their gathered members; of opened nodes only those across components."""
        columns = ["rid", "n", "par", *["root"] * opened]
        rows = leaves if opened else self.reps.select("rid", "par").join(F.broadcast(leaves) if few else leaves, "rid")
        later = lambda x, y: (y["rid"] > x["rid"]) & ((y["root"] != x["root"]) if opened else F.lit(True)) & self.may_link(x["n"], x["par"], y["n"], y["par"])
        pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: later(x, y)), lambda y: F.struct(x["rid"].alias("a"), y["rid"].alias("b")))))
        return rows.groupBy("h").agg(F.collect_list(F.struct(*columns)).alias("m")).select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    def across(self, large: DataFrame, some: Column, few: bool) -> DataFrame:
        """Pairs (a, b) across components within large nodes that may link: `some` of the members by the members outside the largest component, which are broadcast if they are few."""
        large = large.select("h", "t", "rid", "root", "n", "par", "sig", "rare")
        rare = large.where("rare").select("h", *(F.col(c).alias(f"{c}_b") for c in ("rid", "root", "n", "par", "sig")))
        # a pair of two rare members needs one of its two rows only
        once = ~F.col("rare") | (F.col("rid") < F.col("rid_b"))
        met = large.where(some).join(F.broadcast(rare) if few else rare, "h").where((F.col("root") != F.col("root_b")) & once & self.may_link(F.col("n"), F.col("par"), F.col("n_b"), F.col("par_b")) & ~self.met_before(F.col("sig"), F.col("sig_b"), F.col("t")))
        return met.select(F.col("rid").alias("a"), F.col("rid_b").alias("b"))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept."""
        reps = self.rooted(self.reps.select("rid", "key", "doc_id"))
        least = reps.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        ids = reps.select("key", "root").join(least, "root").select("key", "component_id")
        full = self.docs.where("n > 0").select("doc_id", "n", "key").join(ids, "key")
        none = self.docs.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        out = full.select("doc_id", "n", "component_id").unionByName(none)
        return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; documents with 100 * intersection >= percent * union are linked."""
    return Join(spark, docs, shingle, percent).result()


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; all columns stay.

    The documents that go are told by doc_id and text, so texts are moved only where those are too many
    to broadcast. Of rows that repeat the doc_id and text of the document that
    stays, any one stays.
    """
    run = Join(spark, docs, shingle, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    rows = run.docs.where("n > 0").select("doc_id", "th", "key").join(run.rooted(run.reps.select("rid", "key")).select("key", "root"), "key")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    gone = rows.join(first, "root").where(order != F.col("first")).select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).distinct()
    count = run.docs.count()
    gone = written(spark, gone, "near-gone", count)
    again = written(spark, run.docs.where("n > 0").groupBy(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).count().where("count > 1").drop("count"), "near-again", count)
    forget(run.docs, run.reps, run.sets, run.comps)
    same = lambda keys: (text_hash(docs["text"]) == keys["g_th"]) & docs["doc_id"].cast("bigint").eqNullSafe(keys["g_id"])
    kept = docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, same(gone), "left_anti")
    if again.isEmpty():
        return kept
    return kept.join(again, same(again), "left_anti").unionByName(kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, table(spark, sf_dir, "documents"), 3, 85)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS s
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY j)
), sh AS (
  SELECT DISTINCT doc_id, s FROM t WHERE s IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.x, r.m FROM r JOIN e ON e.y = r.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
