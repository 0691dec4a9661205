"""Copyrighted standards: detection by notices, redaction, validity against a catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 500
#: Publishers whose notices mark a standard.
PUBLISHERS = ("SIA", "VSS", "EN", "DIN", "ISO")
NOTICE = r"(?i)licen[sc]e|copyright|©|all rights reserved"
#: Publishers whose catalogues are checked.
CHECKED = ("SIA", "VSS")
#: A number may be written in groups of three digits (40 050).
DESIGNATION = r"\b(SN EN|SIA|VSS|EN|DIN|ISO)\s?([0-9]+(?:[./-][0-9]+|\x20[0-9]{3}\b)*)(?::([0-9]{4}))?"
#: Days between two change-checks of a catalogue.
CHECK_DAYS = 7


def is_norm(text: Column, notice: str = NOTICE, window: int = WINDOW) -> Column:
    """Whether a notice stands within `window` code points of the start or the end. Standards without a title page and those inside other files are not found, on purpose."""
    return F.rlike(F.concat(F.left(text, F.lit(window)), F.lit("\n"), F.right(text, F.lit(window))), F.lit(notice))


def publisher_notice(publishers: Sequence[str] = PUBLISHERS) -> str:
    """A notice that names a publisher and its rights."""
    return rf"(?is)(©|copyright|licen[sc]|urheber).{{0,80}}\b({'|'.join(publishers)})\b|\b({'|'.join(publishers)})\b.{{0,80}}(©|copyright|licen[sc]|urheber)"


def redacted(hits: DataFrame, norm: Column, norm_search: bool = False) -> DataFrame:
    """Hits without the excerpts of standards, unless the reader has opted into searching them."""
    return hits if norm_search else hits.withColumn("excerpt", F.when(~norm, F.col("excerpt")))


def designations(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds publisher, number, year (null if not given) of the first designation."""
    part = lambda n: F.nullif(F.regexp_extract(text, DESIGNATION, n), F.lit(""))
    return rows.withColumn("publisher", part(1)).withColumn("number", part(2)).withColumn("year", part(3).cast("int"))


def newest(catalogue: DataFrame) -> DataFrame:
    """publisher, number, newest edition."""
    return catalogue.groupBy("publisher", "number").agg(F.max("year").alias("newest"))


def validity(norms: DataFrame, catalogue: DataFrame, checked: Sequence[str] = CHECKED, small: bool = False) -> DataFrame:
    """Adds status: outdated if the catalogue has a newer edition, current if not, unchecked if it lacks the number or its publisher is not checked. A small catalogue comes to the rows, which then stay where they are."""
    editions = newest(catalogue)
    rows = norms.join(F.broadcast(editions) if small else editions, ["publisher", "number"], "left")
    known = F.col("newest").isNotNull() & F.col("publisher").isin(list(checked)) & F.col("year").isNotNull()
    return rows.withColumn("status", F.when(known & (F.col("year") < F.col("newest")), "outdated").when(known, "current").otherwise("unchecked")).drop("newest")


def summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def due(checks: DataFrame, now: str, days: int = CHECK_DAYS) -> DataFrame:
    """Catalogues (publisher, ts of a check) whose last change-check is `days` or more ago: publisher, last."""
    return checks.groupBy("publisher").agg(F.max("ts").alias("last")).where(F.col("last") <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def catalogue_of(spark: SparkSession, rows: Sequence[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "publisher string, number string, year int")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A publisher's catalogue from CSV files with a heading: publisher, number, year. Lines without a number or with a year that is none are left out."""
    rows = spark.read.option("header", True).schema("publisher string, number string, year string").csv(path)
    return rows.select(F.trim("publisher").alias("publisher"), F.trim("number").alias("number"), F.trim("year").try_cast("int").alias("year")).where("number <> '' and year is not null")


def catalogue_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """publisher, number, before, now, change: what a change-check finds between two states of catalogues; revised (a newer edition), new, or withdrawn."""
    before, now = newest(old).withColumnRenamed("newest", "before"), newest(new).withColumnRenamed("newest", "now")
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "withdrawn").when(F.col("now") > F.col("before"), "revised")
    return before.join(now, ["publisher", "number"], "full_outer").withColumn("change", change).where("change is not null")


def affected(norms: DataFrame, changes: DataFrame) -> DataFrame:
    """id, publisher, number, change of the stored standards (id, publisher, number, year) that a change concerns: an edition older than the new one, or a withdrawn number."""
    rows = norms.join(changes.where("change <> 'new'"), ["publisher", "number"])
    return rows.where((F.col("change") == "withdrawn") | (F.col("year") < F.col("now"))).select("id", "publisher", "number", "change")
