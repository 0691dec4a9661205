"""Tables in the folder that driver and executors share, and settings for Arrow batches."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_S = 2.0
#: Rows that a task of a written table has at least, where more are known not to come.
TASK_ROWS = 20_000
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset and the master is local, a folder of our own (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN[app]


def written(spark: SparkSession, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: it cuts lineage and survives lost executors.

    most: about how many rows it has at most, where that is known. A small table is then written by few
    tasks, whatever the number of shuffle partitions; a large one by as many as without.
    """
    if most is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-most // TASK_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # most columns are hashes and ids
    # shuffle files that fed the table are deleted once the driver's JVM finds that nothing refers to them, which takes it two or three collections; after short writes there is little to delete
    for _ in range(3 * (time.monotonic() - began > LONG_S)):
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        session = df.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_hash(text: Column | str) -> Column:
    """A 64-bit name of a text within the rows of one doc_id, which together name a document."""
    return F.xxhash64(text)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about 2 MB, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
