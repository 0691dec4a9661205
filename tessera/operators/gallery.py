"""Photos with ratings and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.asof import TARGET, buckets

STARS = 5


def filtered(photos: DataFrame, least: int = 0, tag: str | None = None) -> DataFrame:
    """Photos with at least `least` stars and, if one is given, the tag."""
    shown = photos.where(F.coalesce("rating", F.lit(0)) >= least) if least else photos
    return shown.where(F.array_contains("tags", tag)) if tag else shown


def tagged(photos: DataFrame, chosen: DataFrame, tag: str) -> DataFrame:
    """photos with the tag added to the chosen ones (id)."""
    hit = photos.join(chosen.select("id", F.lit(True).alias("chosen")).distinct(), "id", "left")
    new = F.array_union(F.coalesce("tags", F.expr("cast(array() as array<string>)")), F.array(F.lit(tag)))
    return hit.withColumn("tags", F.when(F.col("chosen"), new).otherwise(F.col("tags"))).drop("chosen")


def rated(photos: DataFrame, chosen: DataFrame, stars: int) -> DataFrame:
    """photos with `stars` (0 to 5) given to the chosen ones (id)."""
    if not 0 <= stars <= STARS:
        raise ValueError("stars are 0 to 5")
    hit = photos.join(chosen.select("id", F.lit(stars).alias("new")).distinct(), "id", "left")
    return hit.withColumn("rating", F.coalesce("new", "rating")).drop("new")


def numbered(rows: DataFrame, key: str, target: int = TARGET) -> DataFrame:
    """rows with n, their place (from 0) by `key`, an integer without nulls: numbered within buckets of keys, each behind the count of those before it, so no task sorts all rows."""
    keyed = rows.withColumn("t", F.col(key).cast("long"))
    bin_of, table = buckets(keyed.select("t"), target)
    placed = keyed.withColumn("bin", bin_of).join(F.broadcast(table), "bin")  # at most BINS rows
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("t")) - 1
    return placed.join(F.broadcast(offsets), "bucket").withColumn("n", F.col("offset") + inside).drop("t", "bin", "bucket", "offset")


def contact_sheet(chosen: DataFrame, columns: int = 3, rows: int = 4) -> DataFrame:
    """id, sheet, row, place (from 1) of chosen photos, by id."""
    cell = lambda x: x.cast("int") + 1
    return numbered(chosen.select("id"), "id").select("id", cell(F.floor(F.col("n") / (columns * rows))).alias("sheet"), cell(F.floor(F.col("n") / columns) % rows).alias("row"), cell(F.col("n") % columns).alias("place"))
