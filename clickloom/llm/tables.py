"""Reading tables and choosing columns for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import BROADCAST_ROWS, bytes_of, new_path, write_table

# written size, compressed, up to which a table is broadcast: some ten times that in memory
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# rows of whole texts in one Arrow batch
TEXT_ROWS = 1_000


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches cut to at most ``TEXT_ROWS`` rows.

    Spark's default of 10,000 rows is made for numbers: with texts of some kilobytes, and copies in the JVM,
    on the way and in Python, such batches are a large part of an executor's memory.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return docs


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) as bigint and string; other columns, whatever their names, stay behind."""
    return text_batches(docs).select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias(text))


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast while the measured ``rows`` are within ``limit``; a shuffled join otherwise."""
    return F.broadcast(df) if rows <= limit else df


def written_broadcast(df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Write ``df`` and hint a broadcast while what was written is within ``limit`` bytes, whatever its rows hold."""
    path = new_path(df.sparkSession, name)
    written = write_table(df, name, path)
    return F.broadcast(written) if bytes_of(df.sparkSession, path) <= limit else written
