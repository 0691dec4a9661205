import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def brute(w, least=pr.LEAST):
    found, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def expected(doc_id, text, least=pr.LEAST, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, least)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def digest(doc_id, text):
    runs, collapsed = expected(doc_id, text)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(lines), sha(collapsed))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(0, 30), st.integers(1, 6), st.sampled_from([2, 5, 12]))
def test_runs_of_equals_brute_force(w, cut, times, least):
    w = w[:5] + w[cut % (len(w) + 1) :] * times + w[3:]
    assert pr.runs_of(w, least) == brute(w, least)


def test_long_repetitive_words():
    rng = random.Random(5)
    base = [rng.randrange(3) for _ in range(400)]
    for w in ([0] * 3000, [0, 1, 0] * 800, base * 4 + base[:100], base + [7] + base):
        assert pr.runs_of(w) == brute(w)


def test_periodic_text_of_a_million_words_ends():
    assert pr.runs_of([0, 1, 2] * 100_000) == [(0, 300_000, 3)]


def test_operator(spark):
    rng = random.Random(3)
    texts = [None, "", " \t ", "a " * 11, "a " * 12, "x y " * 7 + "z", "A a " * 9, "é b  " * 13, "to be or not " * 2000 + "end"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [texts[4]] * 3
    docs = spark.createDataFrame([(i % 70, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    got = {(r.doc_id, r.collapsed, tuple(map(tuple, r.runs))) for r in pr.periodic_runs(docs).collect()}
    want = {(i % 70, c, tuple(r)) for i, t in enumerate(texts) for r, c in [expected(None, t)]}
    assert got == want
    assert pr.periodic_runs(docs).count() == len(texts)
    assert pr.periodic_runs(docs.where("false")).count() == 0
    assert pr.periodic_runs(docs.withColumn("doc_id", pr.F.lit(None).cast("long"))).where("doc_id is null").count() == len(texts)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = pr.op12_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(*r) for r in rows), key=str)
