"""Sparse feature rows: numbers at 0..k-1, categories hashed or numbered behind them.

A sparse row is ``features array<struct<idx int, x double>>``. Everything but the one-hot dictionary is a
row-local expression, so no operator here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.hashing import hashed_slot, prefix_state, slot_after
from clickloom.operators.encode import Dictionary, category_text, value_counts
from clickloom.operators.running import running
from clickloom.options import ColumnRoles, LearnerOptions
from clickloom.session import BROADCAST_ROWS

FEATURES = "array<struct<idx:int,x:double>>"

# fixed value: what the positional file format adds to every positive number
POSITIONAL_OFFSET = 19.0


def cell(idx: Column, x: Column) -> Column:
    return F.struct(idx.cast("int").alias("idx"), x.cast("double").alias("x"))


def _required(number: Column, name: str) -> Column:
    return F.coalesce(number, F.raise_error(F.lit(f"missing number in column {name}")).cast("double"))


def _counted(slots: Column) -> Column:
    """Cells of category slots; a slot that occurs twice in the row gets the value 2."""
    distinct = F.array_distinct(slots)
    plain = F.transform(slots, lambda s: cell(s, F.lit(1.0)))
    merged = F.transform(distinct, lambda s: cell(s, F.size(F.filter(slots, lambda t: t == s))))
    return F.when(F.size(distinct) == F.size(slots), plain).otherwise(merged)


def vectorize_named(
    df: DataFrame,
    roles: ColumnRoles,
    options: LearnerOptions = LearnerOptions(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Sparse rows (row_id, keep..., y, features) from named columns with the hashing trick."""
    offset = len(roles.numeric)
    slots = [
        hashed_slot(c, category_text(c), options.max_features, offset) for c in roles.categorical
    ]
    numbers = [
        cell(F.lit(i), _required(F.col(c).cast("double"), c)) for i, c in enumerate(roles.numeric)
    ]
    return (
        df.select(
            F.col(roles.id).alias("row_id"),
            *keep,
            F.col(roles.target).cast("double").alias("y"),
            F.array(*numbers).cast(FEATURES).alias("_numbers"),
            F.array(*slots).cast("array<int>").alias("_slots"),
        )
        .withColumn("features", F.concat("_numbers", _counted(F.col("_slots"))))
        .drop("_numbers", "_slots")
    )


def vectorize_positional(
    df: DataFrame,
    fields: str,
    roles: ColumnRoles,
    options: LearnerOptions = LearnerOptions(),
    keep: Sequence[str] = (),
    *,
    positive_only: bool = True,
    offset: float = 0.0,
) -> DataFrame:
    """Sparse rows (row_id, keep..., y, features) from an array of text fields addressed by position.

    Zero categories are skipped; with ``positive_only`` numbers that are not positive are skipped too.
    ``offset`` is added to the numbers that stay (POSITIONAL_OFFSET for the original file format).
    ``roles.id`` names a column of ``df``; the other roles are positions.
    """
    texts = F.col(fields)
    k = len(roles.numeric)

    def number(i: int, position: str) -> Column:
        value = _required(F.element_at(texts, int(position) + 1).cast("double"), position)
        kept = cell(F.lit(i), value + offset)
        return F.when(value > 0, kept) if positive_only else kept

    numbers = F.array_compact(F.array(*[number(i, p) for i, p in enumerate(roles.numeric)]))
    slots = F.lit(None).cast("array<int>")
    if roles.categorical:
        places = F.lit([int(p) + 1 for p in roles.categorical])
        states = F.lit([prefix_state(p + "_") for p in roles.categorical]).cast("array<bigint>")
        slots = F.zip_with(
            F.transform(places, lambda p: F.element_at(texts, p)),
            states,
            lambda text, state: F.when(
                text.cast("int") != 0,
                slot_after(state, text, options.max_features, k),
            ),
        )
    return (
        df.select(
            F.col(roles.id).alias("row_id"),
            *keep,
            F.element_at(texts, int(roles.target) + 1).cast("double").alias("y"),
            numbers.cast(FEATURES).alias("_numbers"),
            F.coalesce(F.array_compact(slots), F.array().cast("array<int>")).alias("_slots"),
        )
        .withColumn("features", F.concat("_numbers", _counted(F.col("_slots"))))
        .drop("_numbers", "_slots")
    )


def positional_columns(df: DataFrame, fields: str, roles: ColumnRoles, keep: Sequence[str] = ()) -> DataFrame:
    """The fields of an array of text as columns named by position; categories that are zero are missing."""

    def text(position: str) -> Column:
        return F.element_at(F.col(fields), int(position) + 1)

    return df.select(
        roles.id,
        *keep,
        text(roles.target).alias(roles.target),
        *[text(p).alias(p) for p in roles.numeric],
        *[F.when(text(p).cast("int") != 0, text(p)).alias(p) for p in roles.categorical],
    )


@dataclass(frozen=True)
class OneHotIndex:
    """A dictionary that numbers every (column, value) pair seen in fitting: the way without hashing.

    ``positional`` is for columns of ``positional_columns``: missing categories have no number, and numbers
    that are not positive no cell; ``offset`` is added to those that stay.
    """

    roles: ColumnRoles
    entries: Dictionary
    positional: bool = False
    offset: float = 0.0

    @staticmethod
    def fit(df: DataFrame, roles: ColumnRoles, *, positional: bool = False, offset: float = 0.0) -> OneHotIndex:
        """Number the distinct pairs in (column, value) order, behind the slots of the numbers."""
        pairs = _pairs(df, roles, positional)
        entries = Dictionary.write(_numbered_from(pairs, len(roles.numeric)), "one-hot")
        return OneHotIndex(roles, entries, positional, offset)

    def refit(self, df: DataFrame) -> OneHotIndex:
        """The index grown by the pairs of ``df`` that it lacks, numbered behind the others; no number changes.

        How often a pair occurs, which only tells hot ones from cold ones in large lookups, stays as first seen.
        """
        known = self.entries.table.select("feature", "value")
        new = _pairs(df, self.roles, self.positional).join(known, ["feature", "value"], "left_anti")
        return replace(self, entries=self.entries.grown(_numbered_from(new, self.slots), "one-hot"))

    @property
    def slots(self) -> int:
        """Number of feature slots; the measured size of a model over them."""
        return len(self.roles.numeric) + self.entries.entries

    def transform(
        self,
        df: DataFrame,
        keep: Sequence[str] = (),
        broadcast_rows: int = BROADCAST_ROWS,
    ) -> DataFrame:
        """Sparse rows (row_id, keep..., y, features); pairs not seen in fitting have no cell."""
        roles = self.roles
        nowhere = {"idx": F.lit(None).cast("int")}
        wide, found = self.entries.lookup(
            df, roles.categorical, {"idx": F.col("idx")}, nowhere, broadcast_rows
        )
        values = [_required(F.col(c).cast("double"), c) for c in roles.numeric]
        numbers = [
            F.when(v > 0, cell(F.lit(i), v + self.offset)) if self.positional else cell(F.lit(i), v)
            for i, v in enumerate(values)
        ]
        ones = [
            F.when(found[c]["idx"].isNotNull(), cell(found[c]["idx"], F.lit(1.0)))
            for c in roles.categorical
        ]
        return wide.select(
            F.col(roles.id).alias("row_id"),
            *keep,
            F.col(roles.target).cast("double").alias("y"),
            F.array_compact(F.array(*numbers, *ones)).cast(FEATURES).alias("features"),
        )


def _pairs(df: DataFrame, roles: ColumnRoles, positional: bool) -> DataFrame:
    """Distinct (feature, value) pairs with their counts."""
    counted = value_counts(df, roles.categorical)
    return counted.where("value <> ''") if positional else counted


def _numbered_from(pairs: DataFrame, first: int) -> DataFrame:
    numbered = running(pairs, ["feature", "value"], number="_number")
    return numbered.select("feature", "value", "cnt", (F.col("_number") + first - 1).cast("int").alias("idx"))


def cells(rows: DataFrame) -> DataFrame:
    """Long form of sparse rows: one row per cell, (other columns..., idx, x).

    The outer form keeps Spark from pushing a size check of the array, and with it a second evaluation of
    the vectorizer, below the projection that builds it.
    """
    others = [c for c in rows.columns if c != "features"]
    return rows.select(*others, F.inline_outer("features")).where("idx is not null")
