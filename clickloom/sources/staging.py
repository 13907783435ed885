"""Put a table down as files that a file stream will read back in a given order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_in_order(
    df: DataFrame, batch: str, values: Sequence, path: str, files: int
) -> DataFrame:
    """Append the rows of each batch value in turn, ``files`` files each, and open the folder as a stream.

    A file stream takes files by age, so with ``files`` per trigger each micro-batch is one batch value.
    """
    spark = df.sparkSession
    for value in values:
        df.where(F.col(batch).eqNullSafe(F.lit(value))).repartition(files).write.mode("append").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    if staged.count() != df.count():
        raise ValueError(f"rows whose {batch} is not among the values would be lost")
    found = len(staged.inputFiles())
    if found != files * len(values):
        raise ValueError(f"expected {files} files per batch, found {found} in all; lower files")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
