"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch of texts that goes to Python.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; on a local master (tests), where none is set, one in the temporary folder."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_to = os.path.join(tempfile.gettempdir(), f"tidelog-shared-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def small_batches(df: DataFrame) -> None:
    """Bound the rows of a batch that goes to Python: batches of whole texts of the default size fill a worker's memory."""
    conf = df.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again, which ends its lineage.

    A lost executor then costs the reading of a file, not the work behind it.
    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more, and let Spark's cleaner drop the shuffles behind them."""
    if not tables:
        return
    spark = tables[0].sparkSession
    jvm = spark.sparkContext._jvm
    for df in tables:
        where = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    clean(spark)


def size_of(df: DataFrame) -> int:
    """Bytes of a table that cut() wrote, from its folder; no job."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def clean(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and broadcasts that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus: the fold that a document is in."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def remainder_py(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
