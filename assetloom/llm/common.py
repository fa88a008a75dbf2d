"""Shared helpers: reading tables, shared storage and materialised intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (any path that Spark's readers open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session without it one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.conf.get("assetloom.shared.dir", None)
    if not own:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="assetloom-")
        spark.conf.set("assetloom.shared.dir", own)
    return own


#: Rows of a table, of a few numbers each, that may be sent to every executor.
BROADCAST_ROWS = 100_000


def checked(df: DataFrame, rows: int) -> DataFrame:
    """A small side of a join: broadcast if it has no more than BROADCAST_ROWS rows, else joined by an exchange."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    It cuts the lineage: what follows reads replicated files, so losing an executor never repeats the work
    before this point, and a table that is used twice is computed once. The folder of an application's tables is
    deleted when the application ends; results that should outlive it are written by the caller.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/assetloom-{spark.sparkContext.applicationId}"
    path = f"{home}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(home)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the driver collect its garbage: until then the files of shuffles that nothing refers to any more stay on the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds




def slices(batches, rows: int = 256):
    """Arrow batches cut to at most so many rows, so that a worker holds few texts as Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
