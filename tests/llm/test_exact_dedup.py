import hashlib
import re

from tessera.llm.exact_dedup import CHUNK, exact_dedup, recipes, shared_identifiers


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, group_size string")


def test_edges(spark):
    long_text = "alpha beta gamma delta eleven azur " * 4000
    data = [(3, "a  b", "x"), (1, "a\tb", None), (1, "a\nb", "x"), (None, "a b", "y"), (5, None, "z"), (6, "", "z"), (7, " ", None), (8, long_text, "1"), (9, long_text + " ", "1"), (10, long_text, "1")]
    got = exact_dedup(spark, rows(spark, data)).collect()
    assert len(got) == len(data)
    groups = {}
    for i, t, _ in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for r in got:
        [(norm, ids)] = [(k, v) for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
    assert sum(r.kept for r in got) == len(groups)


def test_empty(spark):
    assert exact_dedup(spark, rows(spark, [])).collect() == []


def test_chunks_cover_text_and_survive_shifts(spark):
    text = " ".join(f"w{i * 7919 % 1000}lno apple" for i in range(5000))
    got = spark.createDataFrame([(1, text), (2, "prefix words " + text)], "doc_id long, text string")
    a, b = (r.chunks for r in recipes(got).orderBy("doc_id").collect())
    assert len(a) > 20 and len({c.id for c in a} & {c.id for c in b}) > 0.8 * len(a)
    assert re.sub(CHUNK, "", text) == ""


def test_shared_identifiers_are_found(spark):
    made = spark.createDataFrame([(0, [(7, bytearray(b"x")), (8, bytearray(b"z"))]), (1, [(7, bytearray(b"y"))])], "rid long, chunks array<struct<id:bigint,digest:binary>>")
    assert [r.id for r in shared_identifiers(made).collect()] == [7]
