"""Texts stored in blocks by id, so that a page of hits or one block of one document is a few small reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.documents import BLOCK

#: Folders that ids are dealt to, by remainder, and bytes of a row group.
BUCKETS, GROUP_BYTES = 64, 1 << 20


@dataclass
class TextStore:
    """blocks: (bucket, id, block_no, text). A folder holds the ids of one remainder, in order, in small row groups."""

    blocks: DataFrame
    buckets: int
    size: int

    def _of(self, ids: Sequence[int]) -> DataFrame:
        """The blocks of the ids. Buckets and ids are literals: other folders are not listed, other row groups not read."""
        if not ids:
            return self.blocks.where(F.lit(False))
        return self.blocks.where(F.col("bucket").isin(sorted({i % self.buckets for i in ids})) & F.col("id").isin(list(ids)))

    def block(self, doc_id: int, block_no: int) -> DataFrame:
        """id, block_no, text of one block; no row where there is none."""
        return self._of([doc_id]).where(F.col("block_no") == block_no).select("id", "block_no", "text")

    def document(self, doc_id: int) -> DataFrame:
        """id, block_no, text of all blocks of a document."""
        return self._of([doc_id]).select("id", "block_no", "text")

    def texts(self, ids: Sequence[int]) -> DataFrame:
        """id, text: whole texts of a page of hits. Empty texts have no blocks and no row."""
        parts = F.array_sort(F.collect_list(F.struct("block_no", "text")))
        return self._of(ids).groupBy("id").agg(parts.alias("parts")).select("id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def write(docs: DataFrame, path: str, buckets: int = BUCKETS, size: int = BLOCK) -> None:
    """Stores the texts of docs (id, text; ids are unique and not null, null texts are empty). A text is cut where it is, before it moves, so a very long one is many rows."""
    count = F.ceil(F.length("text") / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    cut = docs.select("id", "text", F.explode(numbers).alias("block_no")).select(_bucket(F.col("id"), buckets).alias("bucket"), "id", "block_no", F.substr("text", F.col("block_no") * size + 1, F.lit(size)).alias("text"))
    placed = cut.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id", "block_no")
    placed.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(path)
    docs.sparkSession.createDataFrame([(buckets, size)], "buckets int, size int").write.mode("overwrite").json(f"{path}-layout")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(key, F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str) -> TextStore:
    buckets, size = spark.read.schema("buckets int, size int").json(f"{path}-layout").first()
    return TextStore(spark.read.schema("id bigint, block_no int, text string, bucket int").parquet(path), buckets, size)
