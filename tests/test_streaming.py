"""Streams over files that arrive one after another: late rows, repeats, timers, and equality with batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks
from tessera.streaming import logs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


@pytest.fixture
def arrive(spark):
    """Runs a stream over waves of rows (event_id, minute, user_id); each wave is a file of its own."""

    def run(make, *waves):
        source, folder, late = sinks.home(spark), sinks.home(spark), 0
        for wave in waves:
            rows = [(i, T0 + dt.timedelta(minutes=m), u, "view") for i, m, u in wave]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = make(logs.read_events(spark, source, spark.read.parquet(source).schema))
            out, dropped = logs.finished(stream, folder)
            late += dropped
        return out, late

    return run


def minutes(x):
    return int((x - T0).total_seconds() // 60)


def test_late_rows_are_counted_and_close_nothing_anew(arrive):
    out, late = arrive(logs.visits, [(1, 0, 7), (2, 10, 7), (3, 300, 8)], [(4, 15, 7), (5, 280, 8), (6, 900, 9)])
    assert {(r["user_id"], minutes(r["start"]), minutes(r["end"]), r["n"]) for r in out.collect()} == {(7, 0, 40, 2), (8, 280, 330, 2)}
    assert late == 1


def test_repeats_within_the_delay_go(arrive):
    out, _ = arrive(lambda e: logs.once(e, "event_id"), [(1, 0, 7), (1, 5, 7), (2, 3, 7)], [(1, 20, 7), (3, 30, 7)])
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3]


def test_timers_tell_of_idle_keys(arrive):
    out, _ = arrive(logs.expiring, [(1, 0, 7), (2, 30, 8)], [(3, 200, 8), (4, 500, 9)], [(5, 2000, 10)])
    assert {(r["user_id"], minutes(r["last"])) for r in out.collect()} == {(7, 0), (8, 200), (9, 500)}


def test_sliding_windows_equal_the_batch(spark, arrive):
    rows = [(i, i * 7 % 600, i % 3) for i in range(200)]
    out, late = arrive(logs.sliding_counts, rows[:120], [(999, 5000, 0)])
    batch = logs.sliding_counts(spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), u, "view") for i, m, u in rows[:120]], SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")))
    assert late == 0 and sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
