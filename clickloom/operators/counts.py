"""Learning with counts: per category value the share of clicks and of non-clicks, fitted and applied."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.encode import Dictionary, category_text, value_counts
from clickloom.options import MIN_SUPPORT
from clickloom.session import BROADCAST_ROWS


def explode_features(
    df: DataFrame, columns: Sequence[str], label: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per (feature, value) cell, carrying the label and the ``keep`` columns."""
    cells = F.stack(
        F.lit(len(columns)), *[part for c in columns for part in (F.lit(c), category_text(c))]
    )
    return df.select(*keep, F.col(label).cast("double").alias("label"), cells.alias("feature", "value"))


def count_stats(
    df: DataFrame, columns: Sequence[str], label: str, min_support: int = MIN_SUPPORT
) -> DataFrame:
    """Clicks, rows and click shares per (feature, value) with at least ``min_support`` rows."""
    clicks, cnt = F.col("pos"), F.col("cnt")
    counted = value_counts(df, columns, {"pos": F.col(label).cast("double")})
    return counted.where(cnt >= min_support).select(
        "feature",
        "value",
        clicks.cast("bigint").alias("pos"),
        "cnt",
        (clicks / cnt).alias("p1"),
        ((cnt - clicks) / cnt).alias("p0"),
    )


@dataclass(frozen=True)
class CountEncoder:
    """Fitted count statistics, applied as two dense slots per column."""

    columns: tuple[str, ...]
    stats: Dictionary

    @staticmethod
    def fit(
        df: DataFrame, columns: Sequence[str], label: str, min_support: int = MIN_SUPPORT
    ) -> CountEncoder:
        """Fit on ``df``; pass only the training part to keep the labels of the rest out."""
        stats = Dictionary.write(count_stats(df, columns, label, min_support), "count-stats")
        return CountEncoder(tuple(columns), stats)

    @property
    def slots(self) -> list[str]:
        """Names of the encoded columns in slot order: two per column, the label column left out."""
        return [f"{c}_{p}" for c in self.columns for p in ("p1", "p0")]

    def transform(self, df: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """Add ``<column>_p1`` and ``<column>_p0`` per column; unknown and rare values become 0, 0."""
        shares = {p: F.col(p) for p in ("p1", "p0")}
        zeros = {p: F.lit(0.0) for p in ("p1", "p0")}
        wide, found = self.stats.lookup(df, self.columns, shares, zeros, broadcast_rows)
        return wide.select(
            *df.columns,
            *[found[c][p].alias(f"{c}_{p}") for c in self.columns for p in ("p1", "p0")],
        )
