"""Read-only sources: released folders, exported mail, and views of tables as documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAIL = "path string, sender string, subject string, sent_at timestamp, text string"


def file_type(path: Column) -> Column:
    """Lower-case extension of a path's last segment, '' without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./?#]+)(?:[?#].*)?$", 1))


def scan_folders(spark: SparkSession, folders: Sequence[str], pattern: str = "*") -> DataFrame:
    """path, name, ext, size, modified, content of all files below the released folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(folders))
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), file_type(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def read_mail(files: DataFrame) -> DataFrame:
    """MAIL columns of exported messages (path, content), one a file; parts that are no plain text are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email import message_from_bytes, policy
        from email.utils import parsedate_to_datetime

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                m = message_from_bytes(bytes(content or b""), policy=policy.default)
                try:
                    sent = pd.Timestamp(parsedate_to_datetime(m["Date"])).tz_convert("UTC").tz_localize(None) if m["Date"] else None
                except (TypeError, ValueError):
                    sent = None
                body = m.get_body(("plain",))
                rows.append((path, m["From"] and str(m["From"]), m["Subject"] and str(m["Subject"]), sent, body.get_content() if body else ""))
            yield pd.DataFrame(rows, columns=["path", "sender", "subject", "sent_at", "text"])

    return files.select("path", "content").mapInPandas(parse, MAIL)


def read_mailboxes(spark: SparkSession, path: str) -> DataFrame:
    """MAIL columns of the messages in mailbox files (mboxrd); path is the box.

    Spark's text reader splits a box at its message borders, a line that begins with "From ", so one very large
    box is many tasks, and a message is a row before anything is parsed.
    """
    parts = spark.read.option("lineSep", "\nFrom ").option("recursiveFileLookup", "true").text(path)
    message = F.regexp_replace("value", r"\A[^\n]*\n", "")
    whole = F.regexp_replace(message, r"(?m)^>(>*From )", "$1")
    head = F.instr("whole", "\n\n") + 1
    length = F.nullif(F.regexp_extract(F.substr("whole", F.lit(1), head), r"(?mi)^Content-Length:\s*([0-9]+)", 1), F.lit("")).cast("int")
    body = F.substr("whole", head + 1).cast("binary")
    content = F.concat(F.substr("whole", F.lit(1), head).cast("binary"), F.when(length.isNull(), body).otherwise(F.substr(body, F.lit(1), length)))
    return read_mail(parts.where("value <> ''").select(F.col("_metadata.file_path").alias("path"), whole.alias("whole")).select("path", content.alias("content")))


def plain_text(files: DataFrame) -> DataFrame:
    """path, text of text files (UTF-8)."""
    return files.where(F.col("ext").isin("txt", "md", "csv", "html")).select("path", F.decode("content", "UTF-8").alias("text"))


def sheet_text(content: bytes) -> str:
    """The strings of a spreadsheet (xlsx), in the order of its shared strings and then of its sheets' own ones."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = sorted(n for n in z.namelist() if n == "xl/sharedStrings.xml" or (n.startswith("xl/worksheets/") and n.endswith(".xml")))
        return "\n".join(e.text for n in parts for e in ElementTree.fromstring(z.read(n)).iter() if e.tag.endswith("}t") and e.text)


#: Extractors by extension; callers add their own for further formats, such as pdf.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"xlsx": sheet_text}


def extracted_text(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text of files (path, ext, content) in formats that need an extractor; text is null where it fails."""
    by_ext = EXTRACTORS if extractors is None else extractors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for ext, content in zip(batch["ext"], batch["content"], strict=True):
                try:
                    texts.append(by_ext[ext](bytes(content or b"")))
                except Exception:  # a broken file must not end the scan of the others
                    texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.where(F.col("ext").isin(list(by_ext))).select("path", "ext", "content").mapInPandas(run, "path string, text string")


def html_text(html: Column) -> Column:
    """Searchable text of a page: no scripts, styles and comments, a blank for each run of tags and white space."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def mails_view(conversations: DataFrame) -> DataFrame:
    """id, name, path, project, sender, sent_at, text: turns of conversations seen as mails of a thread.

    Ids are negative, so no document has them, and a pairing of conv_id and turn (both not negative, their
    sum below 2**32) gives every mail its own. The table has no dates; a day for each thread and a minute
    for each turn stand in.
    """
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    both = F.col("conv_id") + F.col("turn")
    key = F.expr("-1 - (((conv_id + turn) * (conv_id + turn + 1)) div 2 + turn)")
    sent = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("conv_id") % 365).cast("int"), mins=F.col("turn").cast("int"))
    return conversations.where(both.isNotNull()).select(key.alias("id"), F.concat(name, F.lit(".eml")).alias("name"), F.concat(F.lit("/mail/"), F.col("conv_id").cast("string"), F.lit("/"), name, F.lit(".eml")).alias("path"), F.lit("mail").alias("project"), F.col("role").alias("sender"), sent.alias("sent_at"), "text")


def ocr_route(files: DataFrame) -> DataFrame:
    """Adds route: text (has a text layer), name_only (A1 or larger, at least 594 x 841 mm), ocr (the rest). Columns text, width_mm, height_mm."""
    short, long = F.least("width_mm", "height_mm"), F.greatest("width_mm", "height_mm")
    layer = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return files.withColumn("route", F.when(layer, "text").when((short >= 594) & (long >= 841), "name_only").otherwise("ocr"))


def documents_view(documents: DataFrame) -> DataFrame:
    """id, name, path, project, ext, text: the documents table seen as files /source/lang/id.txt. A null source or lang is the folder "(none)", which policies can name like any other."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    source, lang = (F.coalesce(c, F.lit("(none)")) for c in ("source", "lang"))
    return documents.select(F.col("doc_id").alias("id"), name.alias("name"), F.concat(F.lit("/"), source, F.lit("/"), lang, F.lit("/"), name).alias("path"), source.alias("project"), F.lit("txt").alias("ext"), "text")


def pages_view(pages: DataFrame) -> DataFrame:
    """id, path, project, ext: the pages table seen as files below their host."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    return pages.select(F.col("page_id").alias("id"), path.alias("path"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("project"), file_type(path).alias("ext"))


def photos_view(pages: DataFrame) -> DataFrame:
    """id, rating, tags: pages seen as photos; the id gives the stars (none where it leaves 6), the first folder and a feed mark are the tags."""
    stars = F.col("page_id") % 7
    folder = F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]+)", 1)
    tags = F.filter(F.array(F.nullif(folder, F.lit("")), F.when(F.contains("url", F.lit("source=feed")), "feed")), lambda t: t.isNotNull())
    return pages.select(F.col("page_id").alias("id"), F.when(stars < 6, stars.cast("int")).alias("rating"), tags.alias("tags"))


def sheets_view(documents: DataFrame) -> DataFrame:
    """id, text, width_mm, height_mm: documents seen as scanned sheets of many sizes; each third has no text layer."""
    n = F.col("doc_id")
    return documents.select(n.alias("id"), F.when(n % 3 != 0, F.col("text")).alias("text"), (210 + 105 * (n % 7)).cast("int").alias("width_mm"), (297 + 136 * (n % 5)).cast("int").alias("height_mm"))
