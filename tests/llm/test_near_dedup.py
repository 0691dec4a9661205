import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup as nd


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, c in near.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d, d == (least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows, k, percent):
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, key string, rid int")
    assert sorted((tuple(r) for r in nd.near_dedup(spark, docs, k, percent).collect()), key=str) == brute(rows, k, percent)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_fixture(spark, k, percent):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, k, percent)


def test_large_groups_branch(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    other = base[:60] + [rng.choice(vocabulary) for _ in range(60)]
    for i in range(60):
        w = list(other)
        w[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(w)))
    check(spark, rows, 3, 85)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_large_nodes_lose_no_pair(spark, monkeypatch, k, percent):
    """Pairs just above the threshold within a crowd that shares most of its words, with nodes too large to settle."""
    monkeypatch.setattr(nd, "LEAF", 2)
    monkeypatch.setattr(nd, "MINOR", 0)
    rng = random.Random(11)
    common = [f"c{i}" for i in range(343)]
    rows = []
    for i in range(60):
        w = common + [f"o{i}x{j}" for j in range(57)]
        v = list(w)
        for j in range(10 if percent == 85 else 8):
            v[345 + (5 if percent == 85 else 6) * j] = f"n{i}y{j}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    rng.shuffle(rows)
    want = brute(rows, k, percent)
    assert sum(r[3] for r in want) == 60
    check(spark, rows, k, percent)


def test_trees_follow_from_the_miss_probability():
    for percent in (80, 85, 95):
        n = nd.trees(percent)
        assert (1 - (percent / 100) ** nd.DEPTH) ** n <= nd.MISS < (1 - (percent / 100) ** nd.DEPTH) ** (n - 1)


def test_recall_where_every_node_branches(spark, monkeypatch):
    """Pairs of similarity 0.85 to 0.9 among many that share a third of their words, with leaves so small that paths have full length: at least 0.99 are found by the trees alone, without the finish."""
    monkeypatch.setattr(nd, "LEAF", 1)
    monkeypatch.setattr(nd.Join, "finish", lambda self, last: None)
    rng = random.Random(21)
    shared = [f"s{j}" for j in range(80)]
    rows, n = [], 150
    for i in range(n):
        w = shared + [f"o{i}x{j}" for j in range(160)]
        v = list(w)
        for j in range(4):
            v[90 + 35 * j + rng.randrange(20)] = f"n{i}y{j}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    want = brute(rows, 3, 85)
    assert sum(r[3] for r in want) == n
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sum(r["component_id"] == r["doc_id"] - 1 for r in nd.near_dedup(spark, docs, 3, 85).collect() if r["doc_id"] % 2)
    assert found >= 0.99 * n


def test_slices_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAF", 2)
    monkeypatch.setattr(nd, "PAIRS", 200)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(40):
        w = common[: 250 + i % 50] + [f"o{i // 2}x{j}" for j in range(12)] + [f"z{i}"]
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    check(spark, rows, 3, 85)


def test_edges(spark):
    long_text = " ".join(f"t{i % 977}x{i % 31}" for i in range(60000))
    rows = [(7, None), (8, ""), (9, " \n"), (1, "one"), (2, "ONE"), (3, "one two"), (4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "zz y"), (5, long_text), (6, long_text + " end"), (10, "É é x"), (11, "é É x")]
    check(spark, rows, 3, 85)
    assert nd.near_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (50, 100)]
    got = {r.rid: r.root for r in nd.components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and got[102] == got[101] == got[100] == 50


def test_texts_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(nd, "text_hash", lambda text: F.lit(0).cast("bigint"))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i % 3 * 20 :] + [f"x{i}"])) for i in range(12)] + [(50, "a b c d e f"), (51, "a b c d e f")]
    check(spark, rows, 3, 85)


def crowd():
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(100)]
    rows = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    return rows + [(200 + i, f"alone {i} " + " ".join(f"y{i}x{j}" for j in range(20))) for i in range(9)]


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    parts = {}

    def noted(*args):
        out = written(*args)
        parts[args[2]] = max(parts.get(args[2], 0), len(out.inputFiles()))
        return out

    written = nd.written
    monkeypatch.setattr(nd, "written", noted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        check(spark, crowd(), 3, 85)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    steps = ("classes", "nodes", "pairs", "leaves", "sets", "links", "edges", "components")
    assert {k: n for k, n in parts.items() if k in steps and n > spark.sparkContext.defaultParallelism} == {}


def test_shuffled_where_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(nd, "FEW", 0)
    monkeypatch.setattr(nd, "SMALL", 0)
    check(spark, crowd(), 3, 85)
