"""Readers, logs, rule tables, text stores and segmented indexes: leaks, equality with the plain forms, what is read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import policy, rules, search
from tessera.operators.reader import Reader
from tessera.plans import reading
from tessera.sources import files, segments, sinks, textstore

SF = "/root/testdata/sf0.001"


def numbers(df):
    """Files and bytes that the scans of a run query read, from its plan's metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = {"files": 0, "bytes": 0}, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "FileSourceScanExec":
                metrics = node.metrics()
                found["files"] += metrics.apply("numFiles").value()
                found["bytes"] += metrics.apply("filesSize").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc é\n") for _ in range(rng.choice([0, 1, 7999, 8000, 8001, 30_000])))) for i in range(-40, 160)]
    path = sinks.home(spark)
    textstore.write(spark.createDataFrame([*rows, (500, None)], "id long, text string").repartition(3), path, 16)
    return dict(rows), textstore.read(spark, path)


def test_texts_come_back_whole(spark, store):
    texts, kept = store
    ids = [-40, -3, 0, 17, 99, 500, 12345]
    assert {r["id"]: r["text"] for r in kept.texts(ids).collect()} == {i: texts[i] for i in ids if texts.get(i)}
    for i in (-40, 5, 80):
        assert [r["text"] for r in kept.document(i).orderBy("block_no").collect()] == [texts[i][k : k + 8000] for k in range(0, len(texts[i]), 8000)]
        assert [r["text"] for r in kept.block(i, 1).collect()] == ([texts[i][8000:16000]] if len(texts[i]) > 8000 else [])
    assert kept.texts([]).count() == 0


def test_one_block_reads_one_folder(store):
    _, kept = store
    whole = numbers(kept.blocks)
    one = numbers(kept.block(17, 0))
    assert one["files"] <= 2 and one["bytes"] * 5 < whole["bytes"]


@pytest.fixture(scope="module")
def reader(spark):
    return lambda **more: reading._reader(spark, SF) if not more else Reader(**{**vars(reading._reader(spark, SF)), **more})


def test_nothing_hidden_leaks(spark, reader):
    r = reader()
    shown = {x["id"]: x for x in policy.visible(r.index.entries, r.policy).collect()}
    hidden = [x["id"] for x in r.index.entries.select("id").collect() if x["id"] not in shown]
    assert hidden
    for query in ("the", "license", "src3", "mail user", "zzzz", "", "!!"):
        hits = r.find(query, 10**6)
        assert len(hits) <= 20 and all(h["id"] in shown for h in hits)
        assert all(h["excerpt"] is None for h in hits if shown[h["id"]]["norm"])
    for i in hidden[:5]:
        assert r.read_document(i) == [] and r.resolve([i]) == []
    norm = next(i for i, x in shown.items() if x["norm"])
    assert r.read_document(norm) == [] and reader(norm_search=True).read_document(norm) == []
    assert all(h["excerpt"] for h in reader(norm_search=True).find("license"))
    assert not {x["name"] for x in r.list_folder("/src3")}


def test_hits_know_of_visible_documents_only(spark, reader):
    """Scores equal those of an index in which hidden documents never were."""
    r = reader()
    alone = search.search(r.index.restricted(lambda e: policy.visible(e, r.policy)), "license und the mail")
    assert [(h["id"], h["score"]) for h in r.find("license und the mail")] == [(h["id"], h["score"]) for h in alone.collect()]


def test_each_call_leaves_one_row(spark, reader):
    r = reader(log=sinks.home(spark), now=lambda: dt.datetime(2024, 5, 1, 12))
    calls = [r.find("the"), r.find("zzzz"), r.find(""), r.read_document(-1), r.list_folder("/mail"), r.resolve([1, -1])]
    log = spark.read.parquet(r.log).collect()
    assert len(log) == len(calls) and {x["ts"] for x in log} == {dt.datetime(2024, 5, 1, 12)}
    assert sorted(x["files"] for x in log) == sorted(map(len, calls))
    assert not {"user_id", "host", "ip", "device"} & set(log[0].asDict())


def test_a_large_folder_is_listed_whole(spark):
    """A folder of more names than one page: nothing is cut, in the answer or in the log."""
    n = 2500
    entries = spark.range(n).select("id", F.lit(1).cast("bigint").alias("dl"), F.concat(F.lit("/a/b/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.lit("a").alias("project"), F.lit(False).alias("norm"))
    r = Reader(spark, search.Index(None, entries, None), None, policy.Policy(approved=["a"]), sinks.home(spark))
    names = r.list_folder("/a/b")
    assert len(names) == n and [x["name"] for x in names] == sorted(f"{i}.txt" for i in range(n))
    assert [(x["files"], x["chars"]) for x in spark.read.parquet(r.log).collect()] == [(n, sum(len(f"{i}.txt") for i in range(n)))]
    assert list(r.list_folder("/none")) == []


def as_policy(table):
    ignored = {}
    for k, project, pattern in table:
        if k == "ignore":
            ignored.setdefault(project, []).append(pattern)
    of = lambda kind, i: [r[i] for r in table if r[0] == kind]
    return policy.Policy(of("approve", 1), of("block", 2), ignored, of("wildcard", 2))


PATHS = ["/a/b/c.txt", "/a/b2/c.txt", "/a/B/Löhne 2025.xlsx", "/a/x_y/z%.txt", "/b/a/privat/q", "/b/Fotos privat/1.jpg", "/b/r", "c/d", "/c", "/a/b/", "/back\\slash/f"]


@pytest.mark.parametrize(
    "table",
    [
        [("approve", p, None) for p in "abc"],
        [("approve", "a", None), ("approve", "b", None), ("block", None, "/a/b2"), ("block", None, "/b/r"), ("ignore", "a", "/a/b/"), ("ignore", "b", "/a"), ("ignore", "b", "/b/r")],
        [("approve", p, None) for p in "abc"] + [("wildcard", None, w) for w in ("*privat*", "*_*", "z%*", "*LÖHN*", "q", "?")],
        [("approve", p, None) for p in "abc"] + [("wildcard", None, w) for w in ("*\\*", "c*t", "*2*5*")],
        [("approve", p, None) for p in "abc"] + [("wildcard", None, "**")],
        [("approve", p, None) for p in "abc"] + [("wildcard", None, "")],
        [("approve", p, None) for p in "abc"] + [("block", None, "/")],
    ],
)
def test_rules_equal_the_policy(spark, table):
    docs = spark.createDataFrame([(i, p, q) for i, p in enumerate(PATHS) for q in "abc"] + [(90, None, "a"), (91, "/a/n", None)], "id int, path string, project string")
    got = rules.visible_by(docs, spark.createDataFrame(table, rules.RULES))
    want = policy.visible(docs, as_policy(table)).where("path is not null")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_hundred_thousand_rules(spark):
    docs = spark.range(20_000).select("id", F.concat(F.lit("/p"), (F.col("id") % 9).cast("string"), F.lit("/d"), (F.col("id") % 700).cast("string"), F.lit("/file "), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("p"), (F.col("id") % 9).cast("string")).alias("project"))
    n = F.col("id")
    table = spark.range(100_000).select(F.when(n % 2 == 0, "block").otherwise("wildcard").alias("kind"), F.lit(None).cast("string").alias("project"), F.when(n % 2 == 0, F.concat(F.lit("/p1/d"), n.cast("string"))).otherwise(F.concat(F.lit("file "), (3 * n).cast("string"), F.lit("*"))).alias("pattern"))
    table = table.unionByName(spark.range(9).select(F.lit("approve").alias("kind"), F.concat(F.lit("p"), n.cast("string")).alias("project"), F.lit(None).cast("string").alias("pattern")))
    got = rules.visible_by(docs, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    heads = {str(3 * k) for k in range(1, 100_000, 2)}
    blocked = lambda i: i % 9 == 1 and i % 700 % 2 == 0
    want = [i for i in range(20_000) if not blocked(i) and not any(str(i)[:k] in heads for k in range(1, 6))]
    assert sorted(r["id"] for r in got.collect()) == want


def test_wildcards_meet_few_names(spark):
    """As many patterns as names: what LIKE is asked grows with what matches, not with names times patterns."""
    n = 4000
    names = spark.range(n).select((F.col("id") + 10_000).cast("string").alias("name"))
    table = spark.range(n).select(F.lit("wildcard").alias("kind"), F.lit(None).cast("string").alias("project"), F.concat(F.lit("*"), (F.col("id") * 2 + 10_001).cast("string"), F.lit("*")).alias("pattern"))
    asked = []
    found = rules.matching_names(names, table)
    assert sorted(r["name"] for r in found.collect()) == [str(i) for i in range(10_001, 10_000 + n, 2)]
    todo = [found._jdf.queryExecution().executedPlan()]
    found._jdf.collectToPython()
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            asked.append(node.metrics().apply("numOutputRows").value())
    assert max(asked) <= 4 * n


def state(spark, files):
    return spark.createDataFrame([(p, i, len(t), m, t) for p, (i, t, m) in files.items()], "path string, id long, size long, modified timestamp, text string")


def test_scans_equal_a_full_rebuild(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices([f"t{k}" for k in range(40)], k=rng.randrange(1, 30)))
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    files = {f"/f{i}": (i, text(), at(0)) for i in range(60)}
    index = segments.Segments(spark, sinks.home(spark), 8)
    read = []

    def scan(day):
        now = state(spark, files)

        def texts(asked):
            read[:] = sorted(r["path"] for r in asked.collect())
            return now.join(asked.select("path"), "path", "left_semi").drop("size", "modified")

        return index.update(now.drop("text"), texts)

    def same():
        now = index.open()
        full = search.build_index(state(spark, files).drop("size", "modified"))
        query = "t1 t2 t39"
        want = list(map(tuple, search.search(full, query, k=None).collect()))
        assert sorted(map(tuple, search.search(index.open(query.split()), query, k=None).collect())) == sorted(want)
        assert sorted(r["id"] for r in now.entries.collect()) == sorted(v[0] for v in files.values())

    assert scan(0) == (60, 0, 0)
    assert scan(0) == (0, 0, 0)
    del files["/f3"], files["/f4"]
    files["/f5"] = (5, "t1 t1 new", at(1))
    files["/g"] = (900, text(), at(1))
    assert scan(1) == (1, 1, 2) and read == ["/f5", "/g"]
    files["/f3"] = (3, text(), at(2))
    files["/f5"] = (5, "t2", at(2))
    assert scan(2) == (1, 1, 0) and read == ["/f3", "/f5"]
    same()
    index.merge()
    same()
    files["/h"] = (901, "t7", at(3))
    assert scan(3) == (1, 0, 0)
    before = {r["range"]: r["v"] for r in index.manifest() if r["part"] == "postings"}
    touched = index.merge()
    after = {r["range"]: r["v"] for r in index.manifest() if r["part"] == "postings"}
    assert len(touched) == 1 and all(after[r] == v for r, v in before.items() if r not in touched)
    same()


def test_few_gone_files_move_no_postings(spark):
    """A deleted file's id comes to the postings, whatever size Spark takes their tables for."""
    index = segments.Segments(spark, sinks.home(spark), 4)
    files = {f"/f{i}": (i, f"a b{i}", dt.datetime(2024, 1, 1)) for i in range(9)}
    for gone in (None, "/f2"):
        files.pop(gone, None)
        now = state(spark, files)
        index.update(now.drop("text"), lambda asked, now=now: now.join(asked.select("path"), "path", "left_semi").drop("size", "modified"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.open().postings
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted({r["id"] for r in found.collect()}) == [0, 1, 3, 4, 5, 6, 7, 8]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_scan_yet(spark):
    with pytest.raises(ValueError, match="no scan"):
        segments.Segments(spark, sinks.home(spark)).open()


def test_one_large_box_is_split_at_its_messages(spark):
    texts = ["", "From here\n>From there\n\nFrom", "\n\nFrom x", "é " * 300, "a\n\nb\n", "no end"] * 40
    rows = [("all", None if i % 5 == 0 else f"p{i}@x", f"n{i}", dt.datetime(2024, 1, 1, 0, 0, i % 60), t) for i, t in enumerate(texts)]
    path = sinks.home(spark)
    sinks.write_mailboxes(spark.createDataFrame(rows, "box string, sender string, subject string, sent_at timestamp, text string").coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        mails = files.read_mailboxes(spark, path)
        assert mails.rdd.getNumPartitions() > 8
        got = {r["subject"]: (r["sender"], r["sent_at"], r["text"]) for r in mails.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {subject: (sender, at, text) for _, sender, subject, at, text in rows}
