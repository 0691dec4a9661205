"""As-of and interval joins, vector search, sketches and totals: against brute force, with skew, and their plans."""

import bisect
import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import asof, gallery, intervals, sketches, vectors
from tessera.plans import analytics

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def both_sides():
    """A third of all rows has key 7, many times tie, and nulls stand everywhere."""
    rng = random.Random(1)
    key = lambda: rng.choice([7, 7, 7, 1, 2, 3, 4, 5, None])
    second = lambda: rng.choice([None, *(rng.randrange(5000) for _ in range(20))])
    left = [(i, key(), second()) for i in range(900)]
    right = [(key(), second(), i // 2, rng.choice("xyz")) for i in range(900)] + [(9, 100, 1, "x")]
    return left, right


@pytest.mark.parametrize(("direction", "target", "tolerance"), [("backward", 10**6, None), ("backward", 40, 90), ("forward", 25, None), ("forward", 40, 90)])
def test_asof_equals_brute_force(spark, both_sides, direction, target, tolerance):
    left, right = both_sides
    a = spark.createDataFrame([(i, k, at(s)) for i, k, s in left], "id int, k int, ts timestamp_ntz")
    b = spark.createDataFrame([(k, at(s), v, w) for k, s, v, w in right], "k int, seen timestamp_ntz, v int, ts string")
    got = asof.asof_join(a, b, ["k"], "ts", ["v", "ts"], right_ts="seen", direction=direction, tolerance=tolerance and f"{tolerance} seconds", target=target).collect()
    by = defaultdict(list)
    sign = 1 if direction == "backward" else -1
    for k, s, v, w in right:
        if k is not None and s is not None:
            by[k].append((sign * s, v, w))
    want = Counter()
    for i, k, s in left:
        ok = [] if s is None else [r for r in by.get(k, ()) if r[0] <= sign * s and (tolerance is None or sign * s - r[0] <= tolerance)]
        want[i, k, at(s), *(max(ok)[1:] if ok else (None, None))] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in got) == want


def test_asof_splits_a_hot_key(spark):
    """All rows have one key: no (key, bucket) holds more than the target, and one row is carried into each."""
    n, target = 20_000, 500
    rows = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * F.col("id")).alias("ts"), "id")  # denser at the start
    bin_of, table = asof.buckets(rows.select(F.unix_micros("ts").alias("t")), target)
    sizes = rows.select(F.unix_micros("ts").alias("t")).withColumn("bin", bin_of).join(table, "bin").groupBy("bucket").count().collect()
    assert len(sizes) >= n // target and max(r["count"] for r in sizes) <= 2 * target
    got = asof.asof_join(rows, rows.where("id % 1000 = 0").select("k", "ts", F.col("id").alias("from")), ["k"], "ts", ["from"], target=target)
    assert got.where(F.col("from") == F.col("id") - F.col("id") % 1000).count() == n


def test_asof_of_empty_tables(spark):
    a = spark.createDataFrame([(1, at(5))], "k int, ts timestamp_ntz")
    b = a.withColumn("v", F.lit(3))
    assert asof.asof_join(a, b.where("false"), ["k"], "ts", ["v"]).collect()[0]["v"] is None
    assert asof.asof_join(a.where("false"), b, ["k"], "ts", ["v"]).count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_intervals_equal_brute_force(spark, by):
    rng = random.Random(2)
    value = lambda: rng.choice([None, 50.0, *(rng.uniform(-100, 100) for _ in range(9))])
    points = [(i, rng.choice([1, 1, 2, None]), value()) for i in range(400)]
    lengths = [0.0, -3.0, 1e-6, 0.5, 0.5, 3.0, 7.0, 150.0]
    ranges = []
    for j in range(300):
        low = value()
        ranges.append((j, rng.choice([1, 2, 3]), low, None if low is None or j % 17 == 0 else low + rng.choice(lengths)))
    ranges += [(900, 1, 50.0, 50.5), (901, 1, 49.5, 50.0)]
    a = spark.createDataFrame(points, "id int, k int, x double")
    b = spark.createDataFrame(ranges, "r int, k int, low double, high double")
    got = intervals.interval_join(a if by else a.drop("k"), b if by else b.drop("k"), "x", "low", "high", by)
    want = Counter((i, r) for i, k, x in points for r, j, low, high in ranges if None not in (x, low, high) and low <= x < high and (not by or k == j))
    assert Counter((r["id"], r["r"]) for r in got.collect()) == want


def test_intervals_plan_has_no_nested_loop(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts")
    r = e.select(F.col("event_id").alias("r"), F.col("ts").alias("low"), (F.col("ts") + F.expr("interval 1 hour")).alias("high"))
    plan = intervals.interval_join(e, r, "ts", "low", "high")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.interval_join(e, r.where("false"), "ts", "low", "high").count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_interval_totals_equal_the_pairs(spark, by):
    rng = random.Random(5)
    second = lambda: rng.choice([None, 50, *(rng.randrange(-100, 100) for _ in range(9))])
    points = [(i, rng.choice([1, 1, 2, None]), at(second()), rng.choice([None, rng.random()])) for i in range(500)]
    ranges = [(j, rng.choice([1, 2, 3, None]), at(low), None if low is None or j % 17 == 0 else at(low + rng.choice([-3, 0, 1, 1, 2, 7, 64, 150]))) for j, low in ((j, second()) for j in range(300))]
    a = spark.createDataFrame(points, "id int, k int, x timestamp_ntz, w double")
    b = spark.createDataFrame(ranges, "r int, k int, low timestamp_ntz, high timestamp_ntz")
    got = intervals.interval_totals(a, b if by else b.drop("k"), "x", "low", "high", {"n": ("count", F.lit(1)), "most": ("max", F.col("w")), "first": ("min", F.col("id"))}, by)
    want = {}
    for j, k, low, high in ranges:
        held = [(i, w) for i, q, x, w in points if None not in (x, low, high) and low <= x < high and (not by or (k is not None and k == q))]
        if held:
            want[j] = (len(held), max((w for _, w in held if w is not None), default=None), min(i for i, _ in held))
    assert {r["r"]: (r["n"], r["most"], r["first"]) for r in got.collect()} == want


def test_interval_totals_make_no_pairs(spark):
    """Every range holds every point: 9 million pairs, and no step of the query puts out more than a few rows for each of both."""
    n = 3000
    a = spark.range(n).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).cast("timestamp_ntz").alias("x"))
    b = spark.range(n).select(F.col("id").alias("r"), F.timestamp_seconds(F.lit(1_704_060_000) - F.col("id")).cast("timestamp_ntz").alias("low"), F.timestamp_seconds(F.lit(1_704_080_000) + F.col("id")).cast("timestamp_ntz").alias("high"))
    got = intervals.interval_totals(a, b, "x", "low", "high", {"n": ("count", F.lit(1))})
    assert got.where(f"n = {n}").count() == n == got.count()
    todo, most = [got._jdf.queryExecution().executedPlan()], 0
    got._jdf.collectToPython()
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most <= 30 * n


def test_levels_bound_the_candidates():
    counts = {0: 100_000, 1: 3, 2: 50_000, 9: 40, 20: 1}
    found = intervals.levels(counts)
    assert set(found) == set(counts) and all(found[v] >= v for v in counts)
    assert len(set(found.values())) <= 4 and found[0] == 0
    moved = sum(n * 2 ** (found[v] - v) for v, n in counts.items() if found[v] > v)
    assert moved <= 4 * intervals.SHARE * sum(counts.values())


def nearest(x, ids, q, k, apart=True):
    d = np.round(np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1)), 6)
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if not apart or ids[i] != ids[q]][:k]


@pytest.mark.parametrize("exact", [True, False])
def test_vectors_with_a_hot_cell(spark, monkeypatch, exact):
    """A third of all vectors is one vector: its cell is cut into tiles, and nothing is lost."""
    monkeypatch.setattr(vectors, "ROWS", 40)
    monkeypatch.setattr(vectors, "QUERIES", 5)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16)) * 4
    x = (centre[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16))).astype(np.float32)
    x[::3] = x[0]
    ids = np.arange(600)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(1000, None), (1001, [])], "id long, vector array<float>").repartition(4)
    index = vectors.build(rows)
    asked = rows.where("id % 25 = 0")
    found = defaultdict(list)
    for r in vectors.search(index, asked, 5, 4, exact=exact).orderBy("query", "rank").collect():
        found[r["query"]].append((r["id"], r["distance"]))
    want = {q: nearest(x, ids, q, 5) for q in range(0, 600, 25)}
    if exact:
        assert {q: found[q] for q in want} == want and found.keys() <= {*want, 1000}
    else:
        met = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
        assert met >= 0.9 * 5 * len(want)


def test_vector_index_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    table = rows.toPandas().sort_values("id")
    x, ids = np.stack(table["vector"].to_numpy()), table["id"].to_numpy()
    found = defaultdict(set)
    for r in vectors.search(vectors.build(rows), rows.where("id % 50 = 0")).collect():
        found[r["query"]].add(r["id"])
    asked = [int(i) for i in ids if i % 50 == 0]
    met = sum(len(found[q] & {i for i, _ in nearest(x, ids, int(np.flatnonzero(ids == q)[0]), 10)}) for q in asked)
    assert met >= 0.9 * 10 * len(asked)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, vector array<float>")
    assert vectors.search(vectors.build(none), none).count() == 0


def test_sketches_of_days_give_those_of_longer_spans(spark):
    log = spark.range(60_000).select((F.col("id") * 7919 % 20_011).alias("who"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 60).alias("ts"))
    log = log.unionByName(log.limit(5).withColumn("who", F.lit(None).cast("long")))
    daily = sketches.daily_sketches(log, "who")
    exact = {r["day"]: r["n"] for r in log.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("who").alias("n")).collect()}
    for r in sketches.distinct_by(daily, "day").collect():
        assert abs(r["n"] - exact[r["day"]]) <= 0.03 * exact[r["day"]] + 1
    whole = sketches.distinct_by(daily).first()["n"]
    assert abs(whole - 20_011) <= 0.03 * 20_011


def test_distinct_users_are_exact(spark, tmp_path):
    """More users than a sketch tells apart; the days share some of them, and some events have none."""
    n = F.col("id")
    log = spark.range(60_000).select((n * 7919 % 20_011).alias("user_id"), F.timestamp_seconds(1_704_067_200 + n * 60).cast("timestamp_ntz").alias("ts"))
    log.unionByName(log.limit(5).withColumn("user_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/events.parquet")
    want = defaultdict(set)
    for i in range(60_000):
        when = T0 + dt.timedelta(minutes=i)
        want[f"{when:%Y-%m-%d}"].add(i * 7919 % 20_011)
        want[f"{when:%Y-%m}"].add(i * 7919 % 20_011)
    assert {r["span"]: r["n"] for r in analytics.distinct_users(spark, str(tmp_path)).collect()} == {k: len(v) for k, v in want.items()}


def test_totals_take_one_scan(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    got = sketches.totals(e, [("event_type",), ()], F.count(F.lit(1)).alias("n"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan
    assert got.where("grouping = 1").first()["n"] == e.count()


def test_numbers_without_gaps(spark):
    ids = sorted({i * i % 7919 for i in range(3000)})
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    got = sorted(map(tuple, gallery.numbered(rows, "id", 100).collect()))
    assert got == [(i, n) for n, i in enumerate(ids)]
    assert gallery.numbered(rows.where("false"), "id").count() == 0
