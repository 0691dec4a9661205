"""Log counts as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, glob: str, schema) -> DataFrame:
    """A stream of event files; ts becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Tumbling windows by event type; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")



def sliding_counts(events: DataFrame, late: str = "1 hour", width: str = "2 hours", slide: str = "30 minutes") -> DataFrame:
    """start, event_type, n of overlapping windows; a row counts in width / slide of them, without being repeated before the partial counts."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def visits(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: stretches of events of one key with less than `gap` between neighbours; end is the last event and the gap. State holds open stretches only."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; repeats within the watermark's delay are dropped, and keys are forgotten after it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def expiring(events: DataFrame, key: str = "user_id", after: str = "5 hours", late: str = "1 hour") -> DataFrame:
    """key, last: emitted once a key has had no event for `after`, by the timer of its state; the next event begins anew."""
    hours = _millis(after)

    def idle(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [who[0]], "last": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else -(2**63)
        for batch in batches:
            last = max(last, int(batch["ts"].astype("datetime64[us]").astype("int64").max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + hours, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", late).select(key, "ts")
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(idle, f"{key} {kind}, last timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def _millis(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def finished(stream: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Runs a stream over what its source has now, into Parquet below `folder`; the rows, and how many came too late. Called again it goes on from its checkpoint."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), late
