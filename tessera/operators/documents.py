"""Reading and listing documents, and selections for export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8000


def read_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """id, block_no (from 0), text: the whole document in blocks of `size` code points; an empty one has no block."""
    count = F.ceil(F.length("text") / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return docs.select("id", "text", F.explode(numbers).alias("block_no")).select("id", "block_no", F.substr("text", F.col("block_no") * size + 1, F.lit(size)).alias("text"))


def list_folder(docs: DataFrame, folder: str) -> DataFrame:
    """name, kind of the direct children of a folder."""
    top = folder.rstrip("/") + "/"
    rest = F.substr("path", F.lit(len(top) + 1))
    first = F.split(rest, "/", -1)
    rows = docs.where(F.startswith("path", F.lit(top)) & (rest != "")).select(first[0].alias("name"), F.when(F.size(first) > 1, "folder").otherwise("file").alias("kind"))
    return rows.distinct()


def resolve_ids(docs: DataFrame, ids: Sequence[int]) -> DataFrame:
    """id, path: what opening a hit or a shared link needs."""
    return docs.where(F.col("id").isin(list(ids))).select("id", "path")


def copy_selection(docs: DataFrame, ids: Sequence[int]) -> DataFrame:
    """position, id, path of the chosen documents in the order chosen."""
    order = F.array(*(F.lit(i) for i in ids))
    return docs.where(F.col("id").isin(list(ids))).select(F.array_position(order, F.col("id")).alias("position"), "id", "path")


def merge_selection(docs: DataFrame, ids: Sequence[int], ext: str = "pdf") -> DataFrame:
    """As copy_selection, of one file type only; positions stay gapless."""
    rows = copy_selection(docs.where(F.col("ext") == ext), ids)
    return rows.withColumn("position", F.row_number().over(Window.orderBy("position")).cast("bigint"))


def top_per_project(docs: DataFrame, *order) -> DataFrame:
    """One document of each project, the first in the given order. Spark drops all but the first of each task before the shuffle."""
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where("rank = 1").drop("rank")
