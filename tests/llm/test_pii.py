import hashlib
import math
import re
from collections import defaultdict

from tessera.llm import pii


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def said(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None, "", "a@b.c_d@e.f x@y", "ü 1.2.3.4.5.6.7.8 and 256.1.1.1 000255.0.0.1 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112 49927398716",
    "+1 (555) 123-4567) and +12 +123456789012345678 ++49 30 1234567", "😀 mail 😀x@y.zz😀 +49 170 1234567", "0" * 30000 + " x", "a" * 50000, "1 2 3 " * 9000, "a.b@c.d " * 3000,
    "1" * 20000 + ".1.1.1", "+" + "1-" * 20000, "x@" + "a." * 20000 + "b", "@@@ a@b a@b.c@d.e",
]


def test_base_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    got = pii.digests(pii.pii_scan(spark, docs)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = base(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest(), (r.doc_id, r.spans[:200], said(want)[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert set(said(want).split(",")) <= set(r.spans.split(","))


def brute_terms(texts):
    """Per text the spans of disclosing terms: counts over whole documents, patterns of this module only."""
    n = len(texts)
    n_e, n_t, n_te, held = defaultdict(set), defaultdict(set), defaultdict(set), []
    for i, t in enumerate(texts):
        t = t or ""
        spans = base(t)
        who = {(k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])) for a, k, b in spans}
        rest = list(t)
        for a, _, b in spans:
            rest[a:b] = [" "] * (b - a)
        outside = {w for w in re.findall(r"[^\W_]+", "".join(rest).lower()) if len(w) > 2 and not re.fullmatch("[0-9]+", w)}
        for w in re.findall(r"[^\W_]+", t.lower()):
            n_t[w].add(i)
        for e in who:
            n_e[e].add(i)
            for w in outside:
                n_te[e, w].add(i)
        held.append((who, spans))
    out = []
    for t, (who, cover) in zip(texts, held, strict=True):
        found = set()
        for m in re.finditer(r"[^\W_]+", t or ""):
            for e in who:
                te, ne = len(n_te.get((e, m[0].lower()), ())), len(n_e[e])
                if te >= pii.SUPPORT and ne < n and math.log(te * n / (len(n_t[m[0].lower()]) * ne)) / math.log(n / ne) >= pii.GENERALISE:
                    found.add((m.start(), 4, m.end()))
        out.append(sorted(s for s in found if not any(x < s[2] and s[0] < y for x, _, y in cover)))
    return out


def test_terms_against_brute_force(spark):
    texts = [f"The treasurer Quilliam wrote from q.smith@corp.example about item {i} of the plan" for i in range(4)]
    texts += [f"the plan and item {i} of the day, call +49 170 55512{i % 2}3 today" for i in range(12)] + ["nothing of the kind here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(pii.pii_scan(spark, docs)).collect()}
    want = brute_terms(texts)
    for i, t in enumerate(texts):
        assert got[i].spans == said(sorted(base(t) + want[i])), (i, got[i].spans)
    assert got[0].n_removed >= 2 and got[len(texts) - 3].spans == ""
    assert [got[i].has_pii for i in range(len(texts))] == [bool(base(t)) for t in texts]


def test_random_corpora_against_brute_force(spark):
    """Words that follow some entities more than others, overlapping kinds, repeated documents, nulls."""
    import random

    for seed in range(3):
        rng = random.Random(seed)
        entities = ["a.b@c.example", "10.0.0.7", "4111 1111 1111 1111", "+49 30 1234567", "+378282246310005", "x@y.zz"]
        close = {e: [f"Word{seed}{k}{j}" for j in range(3)] for k, e in enumerate(entities)}
        texts = [None, "", "no data here"]
        for _ in range(60):
            words = [rng.choice("the plan item of day open closes ähnlich 2024".split()) for _ in range(rng.randint(0, 30))]
            for e in rng.sample(entities, rng.randint(0, 3)):
                words.insert(rng.randint(0, len(words)), e)
                words += [w for w in close[e] if rng.random() < 0.8]
            words += [w for e in entities for w in close[e] if rng.random() < 0.02]
            rng.shuffle(words)
            texts.append(rng.choice((" ", "\n", ", ")).join(words))
        texts += rng.sample(texts, 20)
        got = {r.doc_id: r.spans for r in pii.digests(pii.pii_scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
        want = brute_terms(texts)
        assert sum(map(len, want)) > 20
        for i, t in enumerate(texts):
            assert got[i] == said(sorted(base(t) + want[i])), (seed, i, t)


def test_sanitise_text_of_many_spans(spark):
    """More spans than a block, code points beyond the BMP, and overlapping kinds of which the first names the place."""
    many = "".join(f"😀 u{k}@h.example ü 10.0.0.{k % 250}" for k in range(1500)) + " end"
    texts = [many, "+378282246310005 x", "10.0.0.1"]
    got = {r.doc_id: r.text for r in pii.sanitise(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == "😀 <EMAIL> ü <IP>" * 1500 + " end"
    assert got[1] == "<PHONE> x" and got[2] == "<IP>"


def test_sanitise(spark):
    texts = [f"Treasurer Quilliam has q.smith@corp.example and item {i} ok" for i in range(4)] + ["clean words stay"] * 30 + [None]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rid long")
    got = {r.doc_id: r for r in pii.sanitise(spark, docs).collect()}
    assert "<EMAIL>" in got[0].text and "Quilliam" not in got[0].text
    assert got[5].text == "clean words stay" and got[34].text is None and got[3].rid == 3


def test_terms_of_whole_documents(spark):
    """A name behind an invalid number, and words far from the mention, in every place."""
    filler = " ".join(["the plan of the day"] * 20)
    texts = [f"Zebulon opens. card 4111 1111 1111 1111 exp 12/27 Quilliam {filler} Quilliam and Zebulon close" for _ in range(4)] + [filler + " card exp opens and close"] * 30
    got = {r.doc_id: r.text for r in pii.sanitise(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert "<CARD>" in got[0] and "Quilliam" not in got[0] and "Zebulon" not in got[0] and filler in got[0]
    assert got[10] == texts[10]


def test_empty(spark):
    assert pii.digests(pii.pii_scan(spark, spark.createDataFrame([], "doc_id long, text string"))).collect() == []
