"""A search index in segments: a scan adds what changed and marks what is gone, a merge rewrites touched ranges of terms.

Below one folder lie, for each version v,

  state/v      path, id, size, modified of every file the index knows
  entries/v    entries of the files that were added or changed, without text
  postings/v/range=r   their postings; a term's range is a hash, so a search opens the ranges of its terms only
  gone/v       ids that were deleted or changed: they hide rows of earlier versions
  manifest/version=v   the folders that make up the index, and its totals; written last, so a version is there or not

All parts of a version are written before its manifest, over what a failed scan may have left. A reader takes the highest manifest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tessera.operators import search

RANGES = 64
#: Ids of deleted and changed files that may be broadcast, by a count made before; beyond it postings are joined by a shuffle.
SMALL = 1_000_000
FILES = "path string, id bigint, size bigint, modified timestamp"
MANIFEST = "part string, range int, v int, n_docs bigint, avgdl double"


def _range_of(term: Column, ranges: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(ranges)).cast("int")


def few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast where they are few."""
    return F.broadcast(ids) if ids.count() <= SMALL else ids


@dataclass
class Segments:
    """The index below a folder. Its methods are called by one scan at a time; searches may go on meanwhile."""

    spark: SparkSession
    path: str
    ranges: int = RANGES

    def manifest(self) -> list:
        """The live folders of the newest version, at most RANGES and a few for each version since a merge; none before the first scan."""
        try:
            rows = self.spark.read.schema(MANIFEST + ", version int").json(f"{self.path}/manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        newest = rows.agg(F.max("version")).first()[0]
        return rows.where(F.col("version") == newest).collect()

    def _version(self, live: list) -> int:
        return max((r["version"] for r in live), default=-1)

    def _read(self, live: list, part: str, ranges: set[int] | None = None) -> DataFrame | None:
        found = [f"{self.path}/{part}/{r['v']}" + (f"/range={r['range']}" if r["range"] is not None else "") for r in live if r["part"] == part and (ranges is None or r["range"] in ranges)]
        return self.spark.read.parquet(*found) if found else None

    def _without_gone(self, rows: DataFrame, live: list) -> DataFrame:
        gone = self._read(live, "gone")
        if gone is None:
            return rows.drop("v")
        gone = self._last(gone)
        return rows.join(gone, (rows["id"] == gone["id"]) & (rows["v"] < gone["gone_v"]), "left_anti").drop("v")

    def _last(self, gone: DataFrame) -> DataFrame:
        """id, gone_v: the last version that each id left. Few ids come to the postings, which then stay where they are."""
        return few(gone.groupBy("id").agg(F.max("v").alias("gone_v")))

    def open(self, terms: Sequence[str] | None = None) -> search.Index:
        """The index as of now; with `terms`, only the ranges that hold these are read."""
        live = self.manifest()
        ranges = None if terms is None else {zlib.crc32(t.encode()) % self.ranges for t in terms}
        postings, entries = self._read(live, "postings", ranges), self._read(live, "entries")
        if entries is None:
            raise ValueError("no scan has written this index")
        if postings is None:
            postings = self.spark.createDataFrame([], "term string, id bigint, tf bigint, dl bigint, v int")
        row = next(r for r in live if r["part"] == "totals")
        totals = self.spark.createDataFrame([(row["n_docs"], row["avgdl"])], "n_docs bigint, avgdl double")
        return search.Index(self._without_gone(postings, live), self._without_gone(entries, live), totals)

    def _commit(self, live: list[tuple], version: int) -> None:
        entries = self._without_gone(self._read_of(live, "entries"), self._rows(live))
        n, avgdl = search.totals(entries).first()
        rows = [*live, ("totals", None, version, n, avgdl)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version}")

    def _rows(self, live: list[tuple]) -> list[dict]:
        return [{"part": p, "range": r, "v": v} for p, r, v, *_ in live]

    def _read_of(self, live: list[tuple], part: str) -> DataFrame:
        return self._read(self._rows(live), part)

    def _write_postings(self, postings: DataFrame, version: int) -> list[tuple]:
        """Dealt by range, term and id, so a term that every document holds is many tasks' work."""
        dealt = postings.withColumn("range", _range_of(F.col("term"), self.ranges)).repartitionByRange("range", "term", "id")
        rows = dealt.sortWithinPartitions("range", "term", "id").withColumn("v", F.lit(version))
        path = f"{self.path}/postings/{version}"
        rows.write.mode("overwrite").partitionBy("range").parquet(path)
        made = self.spark.read.schema(StructType([f for f in rows.schema if f.name != "range"]).add("range", IntegerType())).parquet(path)
        return [("postings", r["range"], version, None, None) for r in made.select("range").distinct().collect()]  # RANGES at most

    def update(self, listing: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[int, int, int]:
        """Takes up a scan's listing (FILES): files whose size or time changed, new ones, and those that are gone; returns how many of each (added, changed, gone).

        read(files) gives the documents (id, text, more) of the files it is asked for, and is asked for added and
        changed files only. All other texts are not touched.
        """
        live, spark = self.manifest(), self.spark
        version = self._version(live) + 1
        old = self._read(live, "state")
        old = spark.createDataFrame([], FILES) if old is None else old
        before = old.select("path", F.col("id").alias("old_id"), F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
        both = listing.select("path", "id", "size", "modified").join(before, "path", "full_outer")
        kind = F.when(F.col("old_id").isNull(), "added").when(F.col("id").isNull(), "gone").when(F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified")), "same").otherwise("changed")
        both.withColumn("kind", kind).write.mode("overwrite").parquet(f"{self.path}/changes/{version}")
        changes = spark.read.parquet(f"{self.path}/changes/{version}")
        counts = {r["kind"]: r["n"] for r in changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        if version and not counts.keys() & {"added", "changed", "gone"}:
            return 0, 0, 0
        changes.where("id is not null").select("path", "id", "size", "modified").write.mode("overwrite").parquet(f"{self.path}/state/{version}")
        changes.where("kind in ('gone', 'changed')").select(F.col("old_id").alias("id"), F.lit(version).alias("v")).write.mode("overwrite").parquet(f"{self.path}/gone/{version}")
        docs = read(changes.where("kind in ('added', 'changed')").select("path", "id", "size", "modified"))
        made = search.build_index(docs)
        made.entries.withColumn("v", F.lit(version)).write.mode("overwrite").parquet(f"{self.path}/entries/{version}")
        kept = [(r["part"], r["range"], r["v"], None, None) for r in live if r["part"] not in ("state", "totals")]
        new = [("state", None, version, None, None), ("entries", None, version, None, None), ("gone", None, version, None, None), *self._write_postings(made.postings, version)]
        self._commit(kept + new, version)
        return tuple(counts.get(k, 0) for k in ("added", "changed", "gone"))

    def merge(self) -> set[int]:
        """Rewrites the ranges that lie in several versions or hold rows of gone files, and forgets what is gone; returns these ranges. The folders of all others stay as they are."""
        live = self.manifest()
        version = self._version(live) + 1
        by_range: dict[int, int] = {}
        for r in live:
            if r["part"] == "postings":
                by_range[r["range"]] = by_range.get(r["range"], 0) + 1
        touched = {r for r, n in by_range.items() if n > 1}
        gone = self._read(live, "gone")
        alone = set(by_range) - touched
        if gone is not None and alone:
            rows = self._read(live, "postings", alone)
            last = self._last(gone)
            dead = rows.join(last, (rows["id"] == last["id"]) & (rows["v"] < last["gone_v"]), "left_semi")
            touched |= {r["range"] for r in dead.select(_range_of(F.col("term"), self.ranges).alias("range")).distinct().collect()}
        new = []
        if touched:
            new = self._write_postings(self._without_gone(self._read(live, "postings", touched), live), version)
        self._without_gone(self._read(live, "entries"), live).withColumn("v", F.lit(version)).write.mode("overwrite").parquet(f"{self.path}/entries/{version}")
        kept = [(r["part"], r["range"], r["v"], None, None) for r in live if r["part"] == "state" or r["part"] == "postings" and r["range"] not in touched]
        self._commit([*kept, *new, ("entries", None, version, None, None)], version)
        return touched
