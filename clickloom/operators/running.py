"""Positions, ranks and running sums over a global or per-group order, without a one-task window.

A window with no partition key, or with one hot key, sorts everything in a single task. Here the rows are
range-partitioned by the full order (which splits hot groups and ties), the block number of every row is
frozen in a written table, each block computes its own running values, and what came before a block is
added from a small table of carries. A group can only continue into a block as that block's first group,
so there is at most one carry row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import bytes_of, delete_directory, new_path, write_table

# written size of a block, compressed, above which it is too much for one task
BLOCK_BYTES = 64 << 20

# times that ranges are cut anew: the first cut follows the size, further ones follow uneven ranges
_CUTS = 4


def running(
    df: DataFrame,
    order: Sequence[Column | str],
    *,
    sums: dict[str, Column] | None = None,
    number: str | None = None,
    by: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Add running totals in ``order`` (restarting per ``by`` group) to every row.

    ``sums`` maps an output column to the expression that is summed from the first row of the group up
    to and including the current row. ``number`` names a 1-based position column. ``order`` should end
    in a unique key, so that the result does not depend on chance.

    Without ``blocks`` their number follows the size of the rows: what ``spark.sql.shuffle.partitions`` gives is
    measured once it is written, adaptive execution having merged small neighbours, and where a block is above
    ``BLOCK_BYTES`` the ranges are cut anew, as often as it takes.
    """
    measures = dict(sums or {})
    if number:
        measures[number] = F.lit(1).cast("bigint")
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    measured = df.select("*", *[e.alias(f"_in_{name}") for name, e in measures.items()])
    staged, held = _staged(measured, [*map(F.col, by), *order_cols], blocks)
    # one task per block and no second shuffle for the window
    by_block = staged.repartitionById(held, F.col("_block"))

    block_totals = staged.groupBy(*by, "_block").agg(
        *[F.sum(f"_in_{name}").alias(f"_sum_{name}") for name in measures]
    )
    earlier = (
        Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = block_totals.select(
        F.col("_block").alias("_carry_block"),
        *[F.col(c).alias(f"_carry_by_{c}") for c in by],
        F.count(F.lit(1)).over(earlier).alias("_earlier_blocks"),
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_carry_{name}") for name in measures],
    ).where("_earlier_blocks > 0")

    inside = (
        Window.partitionBy("_block", *by)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = by_block.select(
        *df.columns,
        "_block",
        *[F.sum(f"_in_{name}").over(inside).alias(name) for name in measures],
    )
    same_place = local["_block"] == carries["_carry_block"]
    for c in by:
        same_place = same_place & local[c].eqNullSafe(carries[f"_carry_by_{c}"])
    return local.join(F.broadcast(carries), same_place, "left").select(
        *df.columns,
        *[
            (F.col(name) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0))).alias(name)
            for name in measures
        ],
    )


def _staged(rows: DataFrame, order: list[Column], blocks: int | None) -> tuple[DataFrame, int]:
    """The rows written in ranges of ``order``, numbered as ``_block``, and how many numbers there may be."""
    spark, fixed, old = rows.sparkSession, blocks, None
    for cut in range(_CUTS):
        path = new_path(spark, "blocks")
        ranged = rows.repartitionByRange(*([blocks] if blocks else []), *order)
        staged = write_table(ranged.withColumn("_block", F.spark_partition_id()), "blocks", path)
        if old:
            delete_directory(spark, old)
        sizes = staged.groupBy("_block").count()
        last, most, total = sizes.agg(F.max("_block"), F.max("count"), F.sum("count")).first()
        if last is None:
            return staged, 1
        size = bytes_of(spark, path)
        if fixed or most == 1 or cut + 1 == _CUTS or size * most <= BLOCK_BYTES * total:
            return staged, last + 1
        rows, old = staged.drop("_block"), path
        # twice as many as even ranges would need, and more than there were
        blocks = max(-(-2 * size // BLOCK_BYTES), 2 * (last + 1))


def rank_rows(
    df: DataFrame, keys: Sequence[Column | str], position: str = "position", blocks: int | None = None
) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of ``keys`` (any mix of ascending and descending)."""
    numbered = running(df, keys, number=position, blocks=blocks)
    return numbered.withColumn(position, F.col(position) - 1)


def average_ranks(
    df: DataFrame, score: str, rank: str = "average_rank", blocks: int | None = None
) -> DataFrame:
    """One row per distinct score with its row count and its 1-based rank, averaged over ties."""
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("ties"))
    upto = running(counts, [score], sums={"_upto": F.col("ties")}, blocks=blocks)
    return upto.select(
        score, "ties", (F.col("_upto") - F.col("ties") + (F.col("ties") + 1) / 2.0).alias(rank)
    )


def sort_within_groups(
    df: DataFrame,
    group: str,
    keys: Sequence[Column | str],
    *,
    original: str,
    sorted_position: str = "sorted_position",
    head: int | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Position of every row in the sorted order of its group, with all other columns carried along.

    This is argsort and co-sort in long form: ``original`` holds the 0-based position a row had, the new
    column the 0-based position it gets. With ``head`` = n only the first n original positions of each
    group are sorted among themselves and the others stay where they are.
    """
    if head is None:
        ranked = running(df, keys, number=sorted_position, by=[group], blocks=blocks)
        return ranked.withColumn(sorted_position, F.col(sorted_position) - 1)
    is_head = F.coalesce(F.col(original) < head, F.lit(False))
    moved = sort_within_groups(
        df.where(is_head),
        group,
        keys,
        original=original,
        sorted_position=sorted_position,
        blocks=blocks,
    )
    return moved.unionByName(
        df.where(~is_head).withColumn(sorted_position, F.col(original).cast("bigint"))
    )
