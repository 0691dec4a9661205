import random

import pytest

import corpus_pipeline as cp
from tessera.llm import decontaminate, langid, near_dedup
from tests.llm import test_decontaminate, test_line_dedup, test_near_dedup

SF = "/root/testdata/sf0.001"


def reread(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = pairs(docs)
    profiles = langid.train(spark, docs)
    out = reread(spark, cp.language(spark, docs, SF), tmp_path / "0")
    assert out.columns == columns
    told = {i: profiles.predict(t) for i, t in before}
    assert sorted(i for i, _ in pairs(out)) == sorted(i for i, (lang, score) in told.items() if lang != "und" and score >= cp.LEAST_SCORE)

    rows = pairs(out)
    th = [r[0] for r in out.selectExpr("xxhash64(text)").collect()]
    want = {}
    for i, _, _, gone in test_line_dedup.brute(rows, th, cp.SIMILAR_LINES):
        text = dict(rows)[i]
        kept = "\n".join(x for n, x in enumerate(text.split("\n")) if str(n) not in gone.split(","))
        if not gone or kept.strip():
            want[i] = kept
    out = reread(spark, cp.lines(spark, out, SF), tmp_path / "1")
    assert out.columns == columns and dict(pairs(out)) == want
    assert all(r.n_chars == len(r.text) for r in out.collect())

    rows = pairs(out)
    kept = {i for i, _, _, k in test_near_dedup.brute(rows, cp.SHINGLE, cp.SIMILAR) if k}
    out = reread(spark, cp.near_duplicates(spark, out, SF), tmp_path / "2")
    assert out.columns == columns and {i for i, _ in pairs(out)} == kept

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in test_decontaminate.brute(pairs(out), items) if not r[5]}
    out = reread(spark, cp.benchmark(spark, out, SF), tmp_path / "3")
    assert out.columns == columns and {i for i, _ in pairs(out)} == clean

    final = cp.mixture(spark, out, SF).collect()
    assert {r.doc_id for r in final} <= clean and sum(r.taken for r in final) > 0
    assert sorted(map(str, final)) == sorted(map(str, cp.run(spark, SF).collect()))


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_edges(spark, name, stage):
    rows = [(1, "The cat and the dog went home", "en", "src1", 29), (1, "The cat and the dog went home", "en", "src1", 29), (None, None, None, None, None), (3, "", "en", "src2", 0), (4, "12 34", None, None, 5), (5, "le chat et le chien " * 3000, "fr", "x", 60000), (6, "the cat and the dog went home", "en", "src0", 29)]
    docs = spark.createDataFrame([(*r, "e", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rid string, th int")
    out = stage(spark, docs, SF)
    got = out.collect()
    if name != "mixture":
        assert out.schema.names == docs.schema.names
    want = {"language": 4, "lines": 6, "near_duplicates": 5, "benchmark": 7}
    if name in want:
        assert len(got) == want[name], got
    assert stage(spark, docs.where("false"), SF).collect() == []


def test_one_of_each(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.randrange(3)) for _ in range(rng.randrange(9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in near_dedup.one_of_each(spark, docs).collect())
    assert kept == sorted(i for i, _, _, k in test_near_dedup.brute(rows, 5, 80) if k)
