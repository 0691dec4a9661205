"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A normalised text is cut where its own content says so (CHUNK), each chunk becomes a 64-bit
identifier, and a document becomes its ordered list of identifiers, its recipe. Texts are read once
and never move; what is shuffled are identifiers and recipes. Identifiers are verified: distinct
(identifier, SHA-256 of the chunk) pairs are gathered over the corpus, and where an identifier stands
for two digests, the documents that hold it are compared by the digest of the whole text as well.

Defined results: null text counts as empty; a text of white space only is one blank; empty texts equal each
other. Of rows with equal texts exactly one stays: smallest doc_id, null doc_ids last, of rows with
the same doc_id any one. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.native import WHITE, let, whole
from tessera.llm.shared import written
from tessera.session import table

#: 256 to 4096 code points, up to a blank before a word that begins with one of some letter pairs, which are met every few hundred code points in any language with blanks; other texts are cut at 4096.
CHUNK = r"(?s).{256,4095}?\x20(?=[A-Ha-hÀ-ï0-4Ѐ-И一-濿][l-zL-Z5-9И-ӿ]|[^\x00-\x7F])|.{1,4096}"


def recipes(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_chars, text_sha256, chunks: array of (id, digest) in order."""
    norm = docs.select("doc_id", F.regexp_replace(whole(F.col("text")), WHITE, " ").alias("norm"))
    return norm.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.length("norm").cast("long").alias("n_chars"),
        F.sha2(F.col("norm"), 256).alias("text_sha256"),
        F.transform(F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)), lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("chunks"),
    )


def shared_identifiers(made: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk: one column, id."""
    pairs = made.select(F.explode("chunks").alias("c")).select("c.id", "c.digest").distinct()
    return pairs.groupBy("id").count().where("count > 1").select("id")


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks; one row per document."""
    made = written(spark, recipes(docs), "recipes")
    keyed = made.select("rid", "doc_id", "text_sha256", F.size("chunks").cast("long").alias("n_chunks"), "n_chars", F.transform("chunks", lambda c: c["id"]).alias("recipe"))
    doubtful = written(spark, shared_identifiers(made), "shared-ids")
    if doubtful.isEmpty():
        keyed = keyed.withColumn("more", F.lit(""))
    else:
        rows = keyed.select("rid", F.explode(F.array_distinct("recipe")).alias("id")).join(doubtful, "id").select("rid").distinct()
        keyed = keyed.join(rows.withColumn("doubt", F.lit(True)), "rid", "left").withColumn("more", F.when(F.col("doubt"), F.col("text_sha256")).otherwise("")).drop("doubt")
    key = ["h", "n_chars", "more", "recipe"]
    keyed = keyed.withColumn("h", F.xxhash64("recipe"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))
    groups = keyed.groupBy(*key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    out = keyed.join(groups, key)
    return out.select("doc_id", F.col("first.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256", "n_chunks")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS n
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
