"""Sinks: the search index, logs, and lists of files to export. Originals are never written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import Index

#: Bytes of a row group of postings.
GROUP_BYTES = 1 << 20
_LOCAL: dict[str, str] = {}


def home(spark: SparkSession) -> str:
    """A new folder name that driver and executors share: below spark.checkpoint.dir, or on a local master that has none below a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _LOCAL.setdefault(app, _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="tessera-index-"))
    return f"{found.rstrip('/')}/index-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """rows, written below the shared folder and read again: for what is used several times, so that plans stay small."""
    path = home(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_index(index: Index, path: str) -> None:
    """Postings are written where their documents are, sorted by term and id in each file, so that they never move: a query reads the row groups and pages of its terms in each file. Entries are written once, and the totals come from what was written."""
    spark = index.entries.sparkSession
    index.postings.sortWithinPartitions("term", "id").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    index.entries.write.mode("overwrite").parquet(f"{path}/entries")
    spark.read.parquet(f"{path}/entries").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "entries", "totals")))


def append_log(log: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends rows by day, so that retention drops whole folders."""
    log.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def write_mailboxes(mails: DataFrame, path: str) -> None:
    """Mails (box, sender, subject, sent_at, text) as mailbox files (mboxrd, UTF-8), a folder for each box. Null headers are left out; line breaks in headers become blanks."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\n"))).otherwise("")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^(>*From )", ">$1")
    message = F.concat(F.lit("From export\n"), header("From", F.col("sender")), header("Subject", F.col("subject")), header("Date", F.date_format("sent_at", "dd MMM yyyy HH:mm:ss '+0000'")), F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\nContent-Length: "), F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("\n\n"), body)
    mails.select("box", message.alias("value")).write.mode("overwrite").partitionBy("box").text(path)


def write_copies(selection: DataFrame, path: str) -> None:
    """The list of files (or photos) to copy; the copying itself belongs to the file server."""
    selection.write.mode("overwrite").json(path)
