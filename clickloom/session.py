"""Session helpers: the shared folder, written intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# A lookup side is broadcast only when its measured row count is at most this. An int/double pair
# takes about 60 bytes in Spark's long hash relation, so the bound stands for some 240 MB per executor.
BROADCAST_ROWS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clickloom-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


# folder of the scratch space that the code at hand runs in
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch space at hand, or else below the shared folder."""
    return f"{_scope.get() or f'{shared_dir(spark)}/clickloom'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str = "scratch") -> Iterator[str]:
    """A folder for all that jobs write in between, removed with everything in it at the end of the block.

    Results that are DataFrames read from it, so they have to be written elsewhere, or collected, within the
    block. Blocks may be nested; each thread has its own, so what a stream's batches write is not in it.
    """
    path = new_path(spark, name)
    token = _scope.set(path)
    try:
        yield path
    finally:
        _scope.reset(token)
        delete_directory(spark, path)


def write_table(df: DataFrame, name: str, path: str | None = None, tasks: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader over it.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation, and values such as
    block numbers stay the same for every later pass. With ``tasks``, the last step's partitions, however many
    there are, are written by at most so many tasks, one after the other, so there are no more files than that.
    """
    spark = df.sparkSession
    target = path or new_path(spark, name)
    df = df.coalesce(tasks) if tasks else df
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


# rows worth a task of their own where every core has one, and rows that one task may have at most
_LEAST_ROWS = 50_000
_MOST_ROWS = 250_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` in even partitions; where they are few, ``df`` as it is.

    Rows of one row group, or one file, come as one partition however many there are. Work that is long per
    row, or passes over the rows many times, should not be left to that.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-rows // _MOST_ROWS), min(cores, -(-rows // _LEAST_ROWS)))
    return df.repartition(parts) if parts > 1 else df


def delete_directory(spark: SparkSession, path: str) -> bool:
    """Delete a directory tree on whatever file system the path names; False if it was not there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(jvm_path, True)


def bytes_of(spark: SparkSession, path: str) -> int:
    """Size of all files below a path, from the file system alone."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path).getLength()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
