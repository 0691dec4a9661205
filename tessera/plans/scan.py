"""The scan: released folders to a stored index. A batch job, started by hand the first time and by a scheduler later."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import norms, policy, search
from tessera.sources import files, segments, sinks

#: Changed files that are asked for one by one; beyond it the folders that hold them are read.
FEW = 50_000


def _listed(found: DataFrame, folders: Sequence[str], patterns: Sequence[str], ignored: dict[str, Sequence[str]] | None) -> DataFrame:
    """Files below the folders without those that rules exclude: path below its folder, source (where it lies), project (the first folder of path), id (a hash of path)."""
    where = F.regexp_replace("path", "^[a-z]+:/*", "/")
    root = [f.rstrip("/") for f in folders]
    below = F.coalesce(*(F.when(F.startswith(where, F.lit(f + "/")), F.substr(where, F.lit(len(f) + 1))) for f in root), where)
    found = found.withColumn("source", F.col("path")).withColumn("path", below).withColumn("project", F.regexp_extract(below, "^/([^/]+)/", 1))
    return policy.without_ignored(policy.excluded(found, patterns), ignored or {}).withColumn("id", F.xxhash64("path"))


def _documents(found: DataFrame, extractors: dict | None) -> DataFrame:
    """What the index holds of files: text by format, mail headers, marks of standards; found is path and text."""
    mail = files.read_mail(found.where("ext = 'eml'")).select("path", F.concat_ws("\n", "subject", "text").alias("text"), "sender", "sent_at")
    nothing = (F.lit(None).cast("string").alias("sender"), F.lit(None).cast("timestamp").alias("sent_at"))
    html = F.when(F.endswith("path", F.lit(".html")), files.html_text(F.col("text"))).otherwise(F.col("text"))
    text = files.plain_text(found).select("path", html.alias("text"), *nothing).unionByName(files.extracted_text(found, extractors).select("path", "text", *nothing)).unionByName(mail)
    docs = found.select("path", "name", "ext", "project", "modified", "id").join(text, "path", "left")
    docs = docs.withColumn("norm", norms.is_norm(F.coalesce("text", F.lit("")), norms.publisher_notice()))
    return docs.withColumn("found", F.concat_ws("\n", "path", "text"))


def scan(spark: SparkSession, folders: Sequence[str], index_path: str, patterns: Sequence[str] = (), ignored: dict[str, Sequence[str]] | None = None, extractors: dict | None = None) -> search.Index:
    """Reads the folders, drops what rules exclude, extracts text, marks standards and writes the index over path and text.

    Excluded files are dropped by name before their content is read. Files without a text format stay findable
    by name and path. project is the first folder below the released one. ids are hashes of paths.
    """
    docs = _documents(_listed(files.scan_folders(spark, folders), folders, patterns, ignored), extractors)
    sinks.write_index(search.build_index(docs, "found", search.parts_of(docs, "found")), index_path)
    return sinks.read_index(spark, index_path)


def rescan(spark: SparkSession, folders: Sequence[str], index: segments.Segments, patterns: Sequence[str] = (), ignored: dict[str, Sequence[str]] | None = None, extractors: dict | None = None) -> tuple[int, int, int]:
    """Brings a segmented index up to date; how many files were added, changed and deleted. Names, sizes and times of all files are listed; content is read of new and changed ones only.

    Files that a new rule excludes count as deleted.
    """
    listing = _listed(files.scan_folders(spark, folders).drop("content"), folders, patterns, ignored)

    def read(asked: DataFrame) -> DataFrame:
        wanted = listing.join(asked.select("path"), "path", "left_semi").select("source")
        some = [r["source"] for r in wanted.limit(FEW + 1).collect()]
        if len(some) > FEW:
            some = [r["folder"] for r in wanted.select(F.regexp_replace("source", "/[^/]*$", "").alias("folder")).distinct().collect()]
        literal = [re.sub(r"([\\\[\]{}*?])", r"\\\1", x) for x in some]  # names are no patterns
        found = _listed(files.scan_folders(spark, literal), folders, patterns, ignored) if some else listing.withColumn("content", F.lit(None).cast("binary")).limit(0)
        docs = _documents(found.join(asked.select("path"), "path", "left_semi"), extractors)
        return docs.drop("text").withColumnRenamed("found", "text")

    return index.update(listing, read)
