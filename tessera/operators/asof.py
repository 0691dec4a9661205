"""As-of join: each row with the latest earlier (or earliest later) row of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of time should hold, over all keys; bins that are counted to find such buckets.
TARGET, BINS = 1_000_000, 16_384


def buckets(times: DataFrame, target: int = TARGET, bins: int = BINS) -> tuple[Column, DataFrame]:
    """The bin of column t (long), and a table (bin, bucket) of at most `bins` rows: neighbouring bins join until a bucket holds `target` rows.

    Equally deep buckets bound every key: whatever share of the rows one key has, its rows of one bucket are
    at most the bucket's. Only a single bin that holds more by itself exceeds the target.
    """
    low, high = times.agg(F.min("t"), F.max("t")).first()
    step = max(1, ((high or 0) - (low or 0)) // bins + 1)
    bin_of = F.floor((F.col("t") - F.lit(low or 0)) / F.lit(step))
    found, bucket, held = [], 0, 0
    for b, n in times.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect():
        if held and held + n > target:
            bucket, held = bucket + 1, 0
        held += n
        found.append((b, bucket))
    return bin_of, times.sparkSession.createDataFrame(found, "bin long, bucket long")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, columns: Sequence[str], *, right_ts: str | None = None, direction: str = "backward", tolerance: str | None = None, target: int = TARGET) -> DataFrame:
    """All rows of left, with `columns` of the row of right that has the same `by` and the latest time not after `ts` ("backward") or the earliest not before it ("forward"); nulls where there is none, or none within `tolerance` (an interval such as "2 hours").

    Among rows of right with equal times the one with the largest `columns` counts. Keys and times that are
    null match nothing. Both sides are dealt by key and bucket of time, so a hot key is split; what a bucket
    needs from earlier ones is a single row, the key's last before it, carried over from a table with one row
    for each key and bucket.
    """
    sign = {"backward": 1, "forward": -1}[direction]
    micros = lambda c: sign * F.unix_micros(F.col(c).cast("timestamp"))
    keys = [f"key_{i}" for i in range(len(by))]
    named = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    whole = F.col("t").isNotNull()
    for k in keys:
        whole &= F.col(k).isNotNull()
    l_rows = left.select(*named, micros(ts).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("l"))
    r_rows = right.select(*named, micros(right_ts or ts).alias("t"), F.lit(0).alias("side"), F.struct(*columns).alias("r")).where(whole).withColumn("r", F.struct("t", "r"))
    rows = l_rows.where(whole).unionByName(r_rows, allowMissingColumns=True)
    bin_of, table = buckets(rows.select("t"), target)
    rows = rows.withColumn("bin", bin_of).join(F.broadcast(table), "bin").drop("bin")  # at most BINS rows
    of_bucket = rows.groupBy(*keys, "bucket").agg(F.max_by("r", F.when(F.col("side") == 0, F.col("r"))).alias("last"), F.max("side").alias("asked"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_bucket.withColumn("r", F.last("last", ignorenulls=True).over(before)).where((F.col("asked") == 1) & F.col("r").isNotNull())
    carried = carried.select(*keys, "bucket", F.lit(-(2**63)).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["l"].dataType).alias("l"), "r")
    so_far = Window.partitionBy(*keys, "bucket").orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.select(carried.columns).unionByName(carried).withColumn("r", F.last("r", ignorenulls=True).over(so_far)).where("side = 1")
    if tolerance is not None:
        reach = F.expr(f"timestampdiff(MICROSECOND, timestamp_micros(0), timestamp_micros(0) + interval {tolerance})")
        met = met.withColumn("r", F.when(F.col("t") - F.col("r.t") <= reach, F.col("r")))
    alone = l_rows.where(~F.coalesce(whole, F.lit(False))).select("l", F.lit(None).cast(rows.schema["r"].dataType).alias("r"))
    return met.select("l", "r").unionByName(alone).select("l.*", *(F.col("r.r")[c].alias(c) for c in columns))
