import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as pk

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(pk.TOKENIZER)


def checked(plan, histogram, capacity):
    """Sequences of a plan that gives every piece one place."""
    used = Counter()
    for times, items in plan.groups:
        assert times > 0 and sum(n * k for n, k in items) <= capacity
        for n, k in items:
            used[n] += k * times
    assert used == Counter({n: k for n, k in histogram.items() if k})
    return sum(times for times, _ in plan.groups)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 500), max_size=40))
def test_any_histogram_is_packed_once(histogram):
    n = checked(pk.fitted(histogram, 64), histogram, 64)
    assert n >= -(-sum(k * v for k, v in histogram.items()) // 64)


def test_fit_comes_close_to_the_bound():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 2049, 50_000), np.minimum(2048, rng.lognormal(6, 1, 50_000).astype(int) + 1), np.full(999, 1000)):
        histogram = dict(Counter(lengths.tolist()))
        n, least = checked(pk.fitted(histogram), histogram, 2048), max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()) + -(-int((lengths == 1000).sum()) // 2))
        assert n <= least * 1.002 + 1


def test_least_squares_finds_an_exact_mixture():
    p = pk.patterns([300, 700, 1048, 1348, 2048], 2048)
    truth = np.arange(1, len(p) + 1) * 10.0
    histogram = np.zeros(2049)
    for row, x in zip(p, truth, strict=True):
        for n in row[row > 0]:
            histogram[n] += x
    x = pk.least_squares(p, histogram)
    found = np.zeros(2049)
    for row, v in zip(p, x, strict=True):
        for n in row[row > 0]:
            found[n] += v
    assert np.abs(found - histogram).max() < 1


def reference(rows, capacity=2048):
    t = Tokenizer.from_file(PATH)
    out = Counter()
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out[doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def check_rows(rows, got, capacity=2048):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == reference(rows, capacity)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places)


def test_operator_on_odd_texts(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "It's  the\tDOCTOR's 12,5  café café ́x y", "<|endoftext|> a<|startoftext|>B <|ENDOFTEXT|>", "'S 'twas don't, (it's) a.b'c'D 'll'll ,'s", "x\x01y \x01 z\x02", "a-1b,2… «q», é.É e\u0301.x <\u0338 1\u0338 K\u212a", "ΣΣ İ 日本 \U0001f600", "x" * 5000, "word " * 3000, "a"] + ["same text here"] * 5
    texts += [" ".join(rng.choice(["alpha", "Beta", "g,h", "Über"]) for _ in range(rng.randrange(90))) for _ in range(80)]
    rows = [(None if i == 3 else i % 50, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, part string").repartition(4)
    for capacity in (64, 2048):
        got = pk.packed(spark, docs, PATH, capacity, with_ids=True).collect()
        n = check_rows(rows, got, capacity)
        total = sum(r.length for r in got)
        assert n <= -(-total // capacity) + (2 if capacity == 2048 else 0.02 * n + 1)
        assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert pk.packed(spark, docs.where("false"), PATH).count() == 0


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(pk, "KNOWN", 50)
    e, t = pk.Encoder(PATH), Tokenizer.from_file(PATH)
    for k in range(20):
        text = " ".join(f"w{k}x{j}" for j in range(40))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, first = e.encode(raw, np.array([0, len(raw)]), 0)
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 0] and first.tolist() == [0, len(ids)]
        assert len(e.known) <= 90


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = pk.op11_pattern_packing(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = got.collect()
    n = check_rows(rows, got)
    assert n <= -(-sum(r.length for r in got) // 2048) + 2
