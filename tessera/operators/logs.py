"""Search and access logs: no identities, retention, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCH_DAYS, ACCESS_DAYS, LEAST_GROUP, BLOCK = 180, 365, 5, 8000
IDENTITIES = ("user_id", "host", "ip", "device")


def anonymous(log: DataFrame, identities: Sequence[str] = IDENTITIES) -> DataFrame:
    """log without columns that refer to a person or a device."""
    return log.drop(*identities)


def retained(log: DataFrame, now: str, days: int, ts: str = "ts") -> DataFrame:
    """Rows not older than `days` at `now`; a range on ts that reaches the scan."""
    return log.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def access_totals(log: DataFrame, sent: Column, ts: str = "ts", tool: str = "event_type") -> DataFrame:
    """day, tool, calls, chars, blocks: what was sent, by tool and day."""
    rows = log.select(F.date_format(ts, "yyyy-MM-dd").alias("day"), F.col(tool).alias("tool"), F.length(sent).cast("bigint").alias("n"))
    return rows.groupBy("day", "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("chars"), F.sum(F.ceil(F.col("n") / BLOCK)).cast("bigint").alias("blocks"))


def daily_counts(log: DataFrame, *kinds: str, ts: str = "ts") -> DataFrame:
    return log.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), *kinds).agg(F.count(F.lit(1)).alias("n"))


def idle(log: DataFrame, key: str, now: str, hours: int, ts: str = "ts") -> DataFrame:
    """key, last: what had no visit for `hours` at `now`."""
    return log.groupBy(key).agg(F.max(ts).alias("last")).where(F.col("last") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours)))


def published(rows: DataFrame, *keys: str, least: int = LEAST_GROUP) -> DataFrame:
    """Counts of the groups with at least `least` rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
