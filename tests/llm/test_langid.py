import zlib
from collections import Counter

from tessera.llm import langid

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    out = Counter()
    for w in t.split():
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if g != " ":
                    out[g] += 1
    return out


def code(g):
    v = 0
    for c in g:
        v = (v << 21) | ord(c)
    return v


def brute_rank(counts):
    return [g for g, _ in sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][: langid.PROFILE]


def test_grams_and_distance():
    texts = {"a": "Der Baum, der große Baum — steht.", "b": "l'arbre est là, l'arbre", "c": "x"}
    for t in texts.values():
        values, n = langid.counted(langid.grams(t))
        assert dict(zip(values.tolist(), n.tolist(), strict=True)) == {code(g): c for g, c in brute_grams(t).items()}
    p = langid.Profiles({k: langid.ranked(langid.grams(t)) for k, t in texts.items()})
    ranks = {k: brute_rank(brute_grams(t)) for k, t in texts.items()}
    for text in ("der Arbre", "là", "zz 12", "ÀÉ"):
        top = brute_rank(brute_grams(text))
        d = {k: sum(abs(r.index(g) - i) if g in r else langid.PROFILE for i, g in enumerate(top)) for k, r in ranks.items()}
        best = min(sorted(d), key=d.get)
        assert p.predict(text) == (best, 1 - d[best] / (langid.PROFILE * len(top)))
    assert p.predict(None) == p.predict("12 + 3") == p.predict("") == ("und", 0.0)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in langid.op9_langid(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) > 0.97 * len(held)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "x"), (None, "the cat", None, "y"), (2, None, "fr", "z"), (3, "le chat et le chien", "fr", "z"), (4, "123", "fr", None)] * 2, "doc_id long, text string, lang string, score string")
    p = langid.train(spark, docs)
    got = langid.predict(spark, docs, p).collect()
    assert len(got) == 10 and sum(r.lang_pred == "und" for r in got) == 4
    assert langid.keep_known(spark, docs, p, 0.0).count() == 6
    empty = docs.where("false")
    none = langid.train(spark, empty)
    assert langid.predict(spark, empty, none).collect() == [] and {r.lang_pred for r in langid.predict(spark, docs, none).collect()} == {"und"}


def test_many_languages_and_ties(spark):
    rows = [(5 * i + k, text, f"l{i:04d}") for i in range(1200) for k, text in enumerate(("abc def", "abc def", "ghi"))] + [(100_000, "zq zq", "b"), (100_001, "zq zq", "a"), (100_003, "zq zq", "b"), (100_004, "zq zq", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = langid.train(spark, docs)
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert p.langs == sorted(learned) and p.predict("zq") == ("a", p.predict("zq")[1])
    want = Counter()
    for i, text, lang in rows:
        if lang == "l0007" and zlib.crc32(str(i).encode()) % 5:
            want += brute_grams(text)
    k = p.langs.index("l0007")
    assert [int(g) for g in sorted(p.grams[p.ranks[:, k] >= 0], key=lambda g: p.ranks[list(p.grams).index(g), k])] == brute_rank(want)
