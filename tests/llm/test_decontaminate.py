import hashlib
import re

import numpy as np

from tessera.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = tokens(t)
        if w:
            n = min(10, len(w))
            windows += [(i, w[k : k + n]) for k in range(len(w) - n + 1)]
    index = {}
    for i, w in windows:
        index.setdefault(tuple(w), set()).add(i)
    sizes = {len(w) for w in index}
    for i, t in docs:
        w, hit, got = tokens(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in index:
                    hit |= set(range(k, k + n))
                    got |= index[key]
        names = ",".join(sorted("" if x is None else str(x) for x in got))
        yield i, len(w), len(hit), len(got), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def test_fixture(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]))
    got = sorted(tuple(r)[:6] for r in d.report(spark, docs, bench).collect())
    assert got == want and any(x[5] for x in want)


ITEMS = [(1, "one two three"), (12, "a b c d e f g h i j k l"), (2, "A-B c; d e f g h i j"), (None, "solo"), (3, None), (4, "..."), (5, "é ü ñ É"), (1, "one two three"), (7, "rep rep rep")]
TEXTS = [None, "", "one two THREE four", "x a b c d e f g h i j k l y a b c", "b c d e f g h i j k", "a b c d e f g h i", "solo solo", "É ü ñ É é ü ñ É", "rep " * 50, "one two\nthree" * 3000, "q " * 5000 + "a b c d e f g h i j"]


def test_edges(spark):
    docs = spark.createDataFrame([(k if k else None, t, "x") for k, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute([(k if k else None, t) for k, t in enumerate(TEXTS)] * 2, ITEMS), key=str)
    assert sorted((tuple(r)[:6] for r in d.report(spark, docs, bench).collect()), key=str) == want
    assert d.decontaminated(spark, docs, bench).count() == sum(not w[5] for w in want)
    assert d.report(spark, docs.where("false"), bench).collect() == []
    assert not any(r.contaminated for r in d.report(spark, docs, bench.where("false")).collect())


def test_blocks_and_longest(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(d.blocks(spark, bench, 5)) > 3
    docs = spark.createDataFrame([(1, TEXTS[3])], "doc_id long, text string")
    [r] = d.report(spark, docs, bench).collect()
    assert (r.longest_match, r.longest_item, r.longest_at) == (12, "12", 1)
    import pyarrow as pa

    whole, parts = (list(d.shard_report(pa.array(TEXTS), d.blocks(spark, bench, n))) for n in (1000, 5))
    assert whole == parts


def test_blocks_of_several_tasks(spark):
    """Items that share an id in different tasks are one item; a block comes back whole from its short form."""
    import pickle

    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = sorted(brute(list(enumerate(TEXTS)), ITEMS))
    assert len(d.blocks(spark, bench.repartition(4))) > 1
    assert sorted(tuple(r)[:6] for r in d.report(spark, docs, bench.repartition(4)).collect()) == want
    for items in ([], [(str(i), np.array([hash(w) % 97 for w in tokens(t)], np.uint64)) for i, t in ITEMS if tokens(t)]):
        made = d.Block(items)
        again = pickle.loads(pickle.dumps(made))
        assert made.low.tolist() == again.low.tolist() and made.high.tolist() == again.high.tolist() and made.names == again.names


def longest(text, items):
    """(words, place, item) of the longest match that holds a window; ties by place, then item."""
    w, best = tokens(text), (0, 0, "")
    for name, t in items:
        x = tokens(t)
        for i in range(len(x)):
            for p in range(len(w)):
                n = 0
                while i + n < len(x) and p + n < len(w) and x[i + n] == w[p + n]:
                    n += 1
                if n >= min(10, len(x)):
                    best = min(best, (-n, p, str(name)))
    return best


def test_longest_match_against_brute_force():
    """Random texts of few words, with copies, passages cut short and items that share passages; one block, several, and one for each item."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    seen = 0
    for turn in range(25):
        some = lambda n, k: " ".join(rng.choice("abcdef"[:k]) for _ in range(n))
        stems = [some(rng.randint(8, 60), 3) for _ in range(4)]
        items = [(i, rng.choice((rng.choice(stems), some(4, 2), rng.choice(stems) + " " + some(25, 3), some(30, 2), ""))) for i in range(8)]
        pieces = lambda: rng.choice((some(5, 6), some(15, 2), rng.choice(stems), " ".join(rng.choice(stems).split()[rng.randint(0, 3) : rng.randint(10, 40)]), "zz"))
        texts = [" ".join(pieces() for _ in range(rng.randint(0, 6))) for _ in range(9)] + [items[0][1], items[1][1] + " b", None, ""]
        texts += texts[:4]
        held = [(str(i), d.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), d.ALNUM)[0]) for i, t in items if t]
        for size in (1, 3, 100):
            blocks = [Held(d.Block(held[k : k + size])) for k in range(0, len(held), size)]
            got = list(d.shard_report(pa.array(texts), blocks))
            for text, row, want in zip(texts, got, brute(list(enumerate(texts)), items), strict=True):
                assert row[:5] == want[1:], (turn, size, text)
                n, at, item = longest(text, items)
                assert row[5:] == ((-n, item, at) if n else (0, None, None)), (turn, size, text, items)
                seen += -n > 20
    assert seen > 100


class Held:
    """Stands in for a broadcast."""

    def __init__(self, value):
        self.value = value
