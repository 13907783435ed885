"""Row filters and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.hashing import hash_percent
from clickloom.options import TRAIN_PERCENT
from clickloom.session import write_table


def without_text(lines: DataFrame, text: str, column: str = "value") -> DataFrame:
    """Drop the lines that contain ``text``."""
    return lines.where(~F.col(column).contains(text))


def mismatches(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows whose predicted label is missing or differs from the true one."""
    return df.where(~F.col(label).eqNullSafe(F.col(prediction)))


def in_training(key: Column, percent: int = TRAIN_PERCENT) -> Column:
    """True for the rows of the training part; depends on the key alone, so it never changes."""
    return hash_percent(key) < percent


def hash_split(
    df: DataFrame, key: str, percent: int = TRAIN_PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Stable training / hold-out split on a row key."""
    chosen = in_training(F.col(key), percent)
    return df.where(chosen), df.where(~chosen)


def random_split(
    df: DataFrame, percent: int = TRAIN_PERCENT, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Seeded Bernoulli split: one number is drawn per row and written, so the two parts cannot overlap."""
    drawn = write_table(df.withColumn("_drawn", F.rand(seed)), "drawn")
    chosen = F.col("_drawn") < percent / 100.0
    return drawn.where(chosen).drop("_drawn"), drawn.where(~chosen).drop("_drawn")


def sample_negatives(df: DataFrame, label: str, key: str, keep_percent: int) -> DataFrame:
    """Keep every positive row and ``keep_percent`` of the negatives, reweighted to the full count."""
    positive = F.col(label) == 1
    return df.where(positive | (hash_percent(F.col(key)) < keep_percent)).withColumn(
        "weight", F.when(positive, F.lit(1.0)).otherwise(F.lit(100.0 / keep_percent))
    )
