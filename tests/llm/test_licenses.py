import re
from re import _parser

from tessera.llm.license_rules import GATES, RULES
from tessera.llm.licenses import BASE, CONFIDENCE, license_scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    w = f" {' '.join(words)} " if words else " "
    found = [(m.start(), m.end(), p, no, label) for no, (label, p, _, rx) in enumerate(RULES) for m in re.finditer(f"(?<= )(?:{rx})(?= )", w)]
    kept = [d for d in found if not any(o is not d and o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and ((o[0], o[1], o[2]) != (d[0], d[1], d[2]) or o[3] < d[3]) for o in found)]
    score = max([CONFIDENCE[1] if places else 0.0, *(CONFIDENCE[d[2]] for d in kept)])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[4] for d in kept})), score


TEXTS = [
    None,
    "",
    "...",
    "MIT License mit-license, MIT\nLICENSE",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
    "Released under the MIT License. " + "word " * 3000 + "SPDX-License-Identifier: GPL-2.0-or-later",
    "İstanbul ÉTÉ apache license apache license",
    "submit license; mit licenses",
    "PUBLIC DOMAIN DEDICATION AND LICENſE, BlÄ Kelvin MIT LICENİSE, General Public Licenſe",
    "mit license " * 2000,
    "Copyright (c) 2020 Some Body. All rights reserved.",
]


def test_against_brute_force(spark):
    data = [(i, t, "x") for i, t in enumerate(TEXTS)]
    got = license_scan(spark.createDataFrame(data, "doc_id long, text string, labels string")).collect()
    for r in got:
        assert tuple(r)[1:] == brute(TEXTS[r.doc_id]), (r, brute(TEXTS[r.doc_id]))


def test_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan(docs).collect():
        assert tuple(r)[1:] == brute(texts[r.doc_id])


def test_rules_are_gated():
    assert len(RULES) > 200
    assert all(any(g in k for g in GATES) for _, _, k, _ in RULES)


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def examples(items):
    """An example of each alternative of a parsed regex."""
    out = [""]
    for op, x in items:
        op = str(op)
        if op == "LITERAL":
            new = [chr(x)]
        elif op == "SUBPATTERN":
            new = examples(x[3])
        elif op == "BRANCH":
            new = [e for branch in x[1] for e in examples(branch)]
        elif op == "IN":
            new = [chr(v if str(kind) == "LITERAL" else v[0]) for kind, v in x]
        elif op == "NOT_LITERAL":
            new = ["x"]
        elif op == "MAX_REPEAT":
            new = [e * n for n in sorted({x[0], min(max(x[0], 1), x[1])}) for e in examples(x[2])]
        else:
            assert op == "ASSERT_NOT"
            new = [""]
        out = [a + b for a in out for b in new]
    return out


def test_keywords_are_in_every_alternative():
    for label, _, keyword, rx in RULES:
        for text in examples(_parser.parse(rx)):
            assert re.fullmatch(rx, text) and keyword in text, (label, keyword, text)


def test_alternatives_beyond_the_first(spark):
    texts = ["under the zlib/libpng license", "Apache Software License 1.1", "Public Domain Dedication and Licence", "It is MIT licenced", "available under the Apache 2.0", "licensed under the terms of the GNU General Public License"]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert tuple(r)[1:] == brute(texts[r.doc_id]), r
    said = {r.doc_id: set(r.labels.split(",")) for r in got}
    assert all(x in said[i] for i, x in enumerate(("zlib", "apache-1.1", "pddl-1.0", "mit", "apache-2.0", "gpl")))


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "MIT License", "s"), (1, "MIT License", "s"), (None, "Apache License", "s"), (None, None, None)], "doc_id long, text string, score string")
    got = sorted((tuple(r) for r in license_scan(docs).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in ((1, "MIT License"), (1, "MIT License"), (None, "Apache License"), (None, None))), key=str)
    assert license_scan(docs.where("false")).collect() == []
