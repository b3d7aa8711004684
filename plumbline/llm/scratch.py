"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder: the session's ``spark.checkpoint.dir``; a temporary one of our own only in local mode, where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows and bytes of a batch that goes to Python at most. Spark's own 10,000 whole texts take much memory beside an executor's heap.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python from now on, unless the application was given bounds of its own."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, str(most))


#: Paths of the tables written by this process, in order.
made: list[str] = []
#: The paths of tables that are still in use.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: Has Spark delete a query's shuffled rows when the query has ended, instead of when the driver's JVM happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, *, packed: bool = False, by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, and survives the loss of executors.

    packed: its values are packed or random bytes, so that they aren't compressed again (for which whole pages, and thus many large
    values, would be held outside of the heap). What was shuffled for the table goes once it is written.

    by: the last column, of few values; what is filtered by it reads only what has its value.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{folder(spark)}/plumbline-scratch/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{name}"
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(path, partitionBy=by, compression="uncompressed" if packed else None)
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)
    made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def together(*tables: DataFrame) -> DataFrame:
    """The rows of these results of stash, all with the columns of the first, by one scan: the plan doesn't grow with their number."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*(_paths[x] for x in tables))


def forget(*tables: DataFrame) -> None:
    """Deletes these results of stash, which nothing may read any more, be it through a DataFrame made from them."""
    for x in tables:
        if path := _paths.pop(x, None):
            drop(x.sparkSession, [path])


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes these tables, which nothing may read any more."""
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Call it when no DataFrame of ours is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/plumbline-scratch/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_upto(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most this many rows (it is counted, so pass a stashed table); else df, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
