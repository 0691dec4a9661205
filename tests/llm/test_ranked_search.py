import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ranked_search as rs


def ranked(docs, items, k=20):
    """Rows by the definition, every document against every item."""
    term = lambda t: [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    tf = [(d, Counter(term(t))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(x for _, c in tf for x in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tf:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 12 * m)) for x in term(text) if c[x])
            if score > 0:
                found.append((score, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(found[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ß", "a1"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(63)], k=n))
    docs = [(i, text(rng.randrange(1, 80))) for i in range(300)]
    docs += [(1000 + i, "W1 w2, w3; rare") for i in range(40)] + [(5, text(9)), (5, text(9)), (None, "w1 w50 rare"), (7, None), (8, ""), (9, "?? ..."), (2000, "w4 " * 30_000)]
    rng.shuffle(docs)
    items = [(f"i{i}", text(rng.randrange(1, 25))) for i in range(30)] + [("rare", "rare w1 w1"), ("none", None), ("empty", ""), ("unknown", "zzz"), ("i0", "w5 w6")]
    return docs, items


@pytest.mark.parametrize(("size", "most", "opened", "block"), [(1 << 20, 1 << 16, 16, 200_000), (3000, 37, 1, 40)])
def test_equals_scores_of_all_pairs(spark, corpus, monkeypatch, size, most, opened, block):
    monkeypatch.setattr(rs, "OPENED", opened)
    monkeypatch.setattr(rs, "blocks", lambda items, made=rs.blocks: made(items, block))
    docs, items = corpus
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, n int").repartition(3)
    index = rs.build(spark, table, size, most)
    got = rs.search(spark, index, spark.createDataFrame(items, "item_id string, text string"))
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == Counter(ranked(docs, items))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert rs.search(spark, rs.build(spark, docs.where("false")), items).count() == 0
    assert rs.search(spark, rs.build(spark, docs.where("doc_id = 2")), items).count() == 0
    assert rs.search(spark, rs.build(spark, docs), items.where("false")).count() == 0
    assert [tuple(r) for r in rs.search(spark, rs.build(spark, docs), items).collect()] == ranked([(1, "a b")], [("x", "a")])


def test_levels_give_back_the_postings():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        pairs = sorted({(int(d), int(t)) for d, t in zip(rng.integers(0, n, 200), rng.integers(0, 9, 200), strict=True)} | {(d, 3) for d in range(n)})
        doc, term = (np.array(x) for x in zip(*pairs, strict=True))
        tf = rng.integers(1, 5, len(doc))
        ids = rng.permutation(n) * 10
        row = rs.shard_row(ids, np.full(n, 7), [(doc, term.astype(np.uint64), tf)], n, 7 * n)
        shard = rs.Shard(row, n, 7 * n)
        found = defaultdict(list)
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(doc)).astype(bool) for x in row["levels"]]
        for t, d in zip(np.repeat(shard.terms, np.diff(shard.starts)), shard._numbers(bits), strict=True):
            found[int(t)].append(int(shard.ids[d]))
        assert {t: sorted(x) for t, x in found.items()} == {t: sorted(int(ids[d]) for d, u in pairs if u == t) for t in found}
        assert all((np.diff(shard.value[0][a:b]) <= 0).all() for a, b in zip(shard.starts, shard.starts[1:], strict=False))
