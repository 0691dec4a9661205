import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup as ld


def tokens(line):
    return frozenset(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute(rows, th, percent):
    """Per row the numbers of removed lines. th: order among rows with one doc_id."""
    lines, seen = [], set()
    for r, (i, t) in enumerate(rows):
        for n, line in enumerate((t or "").split("\n")):
            if s := tokens(line):
                lines.append(((i is None, i or 0, th[r], n), r, n, s))
    lines.sort(key=lambda x: x[0])
    by, gone = {}, {}
    for k, (order, r, n, s) in enumerate(lines):
        if (order, s) in seen:  # a repeated row
            gone[r] = gone[[x for x in range(len(rows)) if rows[x] == rows[r]][0]]
            continue
        seen.add((order, s))
        common = {}
        for w in s:
            for j in by.get(w, ()):
                common[j] = common.get(j, 0) + 1
        gone.setdefault(r, [])
        if any(100 * c >= percent * (len(s) + len(lines[j][3]) - c) for j, c in common.items()):
            gone[r].append(n)
        for w in s:
            by.setdefault(w, []).append(k)
    return sorted(((i, (t or "").count("\n") + 1, len(gone.get(r, [])), ",".join(map(str, gone.get(r, [])))) for r, (i, t) in enumerate(rows)), key=str)


def check(spark, rows, percent=80):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    th = [r[0] for r in spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("xxhash64(text)").collect()]
    got = sorted((tuple(r) for r in ld.line_report(spark, docs, percent).collect()), key=str)
    assert got == brute(rows, th, percent)
    return docs


def test_fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_variants(spark, percent):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(6)):
            w = rng.choice(lines).split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text.append(" ".join(w))
        rows.append((rng.randrange(10_000), "\n".join(text)))
    check(spark, rows, percent)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, "\n\n"), (3, "a b c d e\n\nA, b; c d e!"), (2, "e d c b a"), (2, "e d c b a"), (None, "a b c d e\nnew line é"), (1, "É é\né É"), (9, "x " * 70000 + "\n" + "y z\r\nz y")]
    docs = check(spark, rows)
    kept = {(r.doc_id, r.text) for r in ld.without_repeated_lines(spark, docs).collect()}
    assert (2, "e d c b a") in kept and (None, "new line é") in kept and (5, None) in kept and (6, "") in kept and not any(i == 3 for i, _ in kept)
    assert ld.line_report(spark, docs.where("false")).collect() == [] and ld.without_repeated_lines(spark, docs.where("false")).collect() == []


def test_texts_of_one_hash(spark, monkeypatch):
    monkeypatch.setattr(ld, "text_hash", lambda text: F.lit(0).cast("bigint"))
    rows = [(i, f"line number {i % 4} of the text a b c\nanother one {i} x y z") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ld.line_report(spark, docs).collect()), key=str) == brute(rows, [0] * len(rows), 80)
