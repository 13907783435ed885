"""FTRL-Proximal logistic regression as set-based DataFrame steps.

State is a table, one row per feature slot: ``idx, z, n, seen`` (adjusted gradient sum, squared-gradient
sum, cells seen). The reserved slot -1 carries the running scalars of the learner: rows seen, their weight
(as n), sum of labels, sum of the progressive loss. A slot without a row is all zero. Rows may have a weight,
which then counts in gradients, labels and losses, as a row that stands for several others should.

One step scores a batch with the state before it, then adds the batch's gradient. With one row per batch
this is the record-at-a-time algorithm; with more rows it is the delayed-gradient form. A step costs one
scan of the batch (two when the rows are needed to spread the probabilities back over their cells) and one
shuffle by slot, in which gradients are summed on the map side before they move. The state itself stays where
it is: it is written in buckets of slots, and gradients come to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.scalar import LOGISTIC, Loss
from clickloom.operators.lookup import lookup_join
from clickloom.options import FtrlParams
from clickloom.session import (
    BROADCAST_ROWS,
    delete_directory,
    new_path,
    shuffle_partitions,
    write_table,
)

SCALARS = -1

# weight of a row, 1 where there is no such column
WEIGHT = "weight"

# own number of a row: callers' ids are labels, which may repeat or be missing
KEY = "_key"

# rows of one batch that are worth a task of their own, when the number of buckets is chosen
TASK_ROWS = 20_000

STATE = "idx int, z double, n double, seen bigint, label_sum double, loss_sum double"


def empty_state(spark: SparkSession) -> DataFrame:
    names_and_types = [column.split(" ") for column in STATE.split(", ")]
    return spark.range(0).select(*[F.lit(0).cast(t).alias(c) for c, t in names_and_types])


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with a number of their own, fixed in a written table unless they have one."""
    if KEY in rows.columns:
        return rows
    return write_table(rows.withColumn(KEY, F.monotonically_increasing_id()), "keyed-rows")


def _double(value: float) -> str:
    return f"{float(value)!r}D"


def weight(p: FtrlParams) -> str:
    """SQL of the lazy weight of a slot over its z and n: exactly 0 while |z| <= l1."""
    l1, l2, alpha, beta = map(_double, (p.l1, p.l2, p.alpha, p.beta))
    return (
        f"CASE WHEN abs(z) <= {l1} THEN 0D"
        f" ELSE (IF(z >= 0, {l1}, -{l1}) - z) / ({l2} + ({beta} + sqrt(n)) / {alpha}) END"
    )


def model_of(state: DataFrame) -> DataFrame:
    """(idx, z, n) of the feature slots."""
    return state.where(F.col("idx") > SCALARS).select("idx", "z", "n")


def weights_of(state: DataFrame, params: FtrlParams) -> DataFrame:
    """(idx, w) of the feature slots."""
    return model_of(state).selectExpr("idx", f"{weight(params)} AS w")


def progress_of(state: DataFrame) -> DataFrame:
    """One row (rows, label_sum, loss_sum, base_rate) over everything seen so far, epochs included."""
    return state.where(F.col("idx") == SCALARS).select(
        F.col("seen").alias("rows"),
        "label_sum",
        "loss_sum",
        # a step of the caller's own need not keep weights
        (F.col("label_sum") / F.coalesce(F.nullif("n", F.lit(0.0)), F.nullif("seen", F.lit(0)))).alias("base_rate"),
    )


@dataclass(frozen=True)
class Ftrl:
    """The learner: hyper-parameters, loss, and how its weights are looked up.

    ``slots`` is the number of feature slots when that is known beforehand, as it is under the hashing
    trick: all features lie below it. While it is within ``broadcast_rows`` the weights of these slots are
    broadcast without being counted; otherwise their number is measured, and larger models are joined by
    shuffle with the hot slots split off.
    """

    params: FtrlParams = FtrlParams()
    loss: Loss = LOGISTIC
    slots: int | None = None
    broadcast_rows: int = BROADCAST_ROWS

    def margins(self, rows: DataFrame, state: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """(number of the row, carried columns, margin): sum of weight times value over the cells of each row.

        A row without cells has the margin 0. Carried columns ride along, so nothing has to be joined back.
        """
        flat = keyed(rows).select(KEY, *carry, F.inline_outer("features"))
        known = (
            state.where(f"idx > {SCALARS}")
            .selectExpr("idx", "seen", f"{weight(self.params)} AS w")
            .where("w <> 0")
        )
        size, total = 0, 0
        if self.slots is not None and self.slots <= self.broadcast_rows:
            # whatever else a state that was handed in may hold, there are no more rows than slots
            known = known.where(F.col("idx") < self.slots)
        else:
            measured = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("seen"), F.lit(0))).first()
            size, total = measured[0], measured[1]
        looked_up = lookup_join(
            flat,
            known,
            "idx",
            "idx",
            {"w": F.col("w")},
            lookup_rows=size,
            occurrences="seen",
            total=total,
            limit=self.broadcast_rows,
            stored=True,
        )
        part = F.coalesce(F.col("x") * F.col("w"), F.lit(0.0))
        return looked_up.groupBy(KEY, *carry).agg(F.sum(part).alias("margin"))

    def predict(self, rows: DataFrame, state: DataFrame, out: str = "probability") -> DataFrame:
        """Add the probability of class 1 to every row."""
        numbered = keyed(rows)
        margins = self.margins(numbered, state)
        return numbered.join(margins, KEY, "left").select(
            *rows.columns, self.loss.link(F.col("margin")).alias(out)
        )

    def score(self, rows: DataFrame, state: DataFrame, out: str = "probability") -> DataFrame:
        """(row_id, probability), one row per input row and in one shuffle; ids may repeat or be missing."""
        return self.labelled_scores(rows, state, ["row_id"], out)

    def labelled_scores(
        self, rows: DataFrame, state: DataFrame, carry: Sequence[str] = ("row_id", "y"), out: str = "probability"
    ) -> DataFrame:
        """The carried columns of every row and its probability of class 1, in one shuffle."""
        return self.margins(rows, state, carry).select(*carry, self.loss.link(F.col("margin")).alias(out))

    def step(self, state: DataFrame, rows: DataFrame) -> DataFrame:
        """State after one batch of rows (y, features); a slot may occur once per row.

        z gains the sum of the gradients, n the sum of their squares, each taken per record, so the rates
        fall as they do record by record, however many rows a batch has.
        """
        weighted = [WEIGHT] if WEIGHT in rows.columns else []
        scored = self.predict(keyed(rows).select(KEY, "y", "features", *weighted), state, "_p")
        # one more cell per row, for the running scalars
        anchor = f"array(named_struct('idx', {SCALARS}, 'x', 0D))"
        share = F.col(WEIGHT).cast("double") if weighted else F.lit(1.0)
        flat = scored.select("y", "_p", share.alias("share"), F.expr(f"inline(concat(features, {anchor}))"))
        p, y, x = F.col("_p"), F.col("y"), F.col("x")
        gained = (
            flat.select(
                "idx",
                "share",
                (F.col("share") * self.loss.gradient(p, y, x)).alias("g"),
                (F.col("share") * self.loss.cost(p, y)).alias("cost"),
                (F.col("share") * y).alias("y"),
            )
            .selectExpr(
                "idx",
                f"IF(idx = {SCALARS}, 0D, g) AS g",
                f"IF(idx = {SCALARS}, share, g * g) AS gg",
                f"IF(idx = {SCALARS}, y, 0D) AS more_labels",
                f"IF(idx = {SCALARS}, cost, 0D) AS more_loss",
            )
            .groupBy("idx")
            .agg(*[F.sum(c).alias(c) for c in ("g", "gg", "more_labels", "more_loss")], F.count(F.lit(1)).alias("more"))
        )
        merged = state.join(gained, "idx", "full_outer").selectExpr(
            "idx", *[f"coalesce({c}, 0D) AS {c}" for c in ("z", "n", "g", "gg")],
            "coalesce(seen, 0L) + coalesce(more, 0L) AS seen",
            *[f"coalesce({c}, 0D) + coalesce({m}, 0D) AS {c}" for c, m in (("label_sum", "more_labels"), ("loss_sum", "more_loss"))],
        )
        rate = f"(sqrt(n + gg) - sqrt(n)) / {_double(self.params.alpha)}"
        return merged.selectExpr(
            "idx",
            f"z + g - {rate} * ({weight(self.params)}) AS z",
            "n + gg AS n",
            "seen",
            "label_sum",
            "loss_sum",
        )


@dataclass(frozen=True)
class FeatureTable:
    """Sparse rows written once for all epochs: a directory per batch, bucketed by row number within it.

    A step then reads only its own batch, and neither the margins (grouped by row) nor the probabilities
    (joined back by row) need a shuffle. ``batches`` holds the batch values in order, a missing one first.
    """

    spark: SparkSession
    name: str
    path: str
    batch: str
    batches: tuple

    @staticmethod
    def write(rows: DataFrame, batch: str, buckets: int | None = None) -> FeatureTable:
        """Write ``rows``; the number of buckets follows the largest batch, up to the shuffle partitions."""
        spark = rows.sparkSession
        # one result row per learning step of an epoch: the driver runs a job for each of them anyway
        sizes = {r[0]: r[1] for r in rows.groupBy(batch).count().toLocalIterator()}
        order = tuple(sorted(sizes, key=lambda v: (v is not None, v)))
        wanted = -(-max(sizes.values(), default=1) // TASK_ROWS)
        n = buckets or min(wanted, shuffle_partitions(spark))
        table = FeatureTable(
            spark, f"clickloom_rows_{uuid.uuid4().hex}", new_path(spark, "rows"), batch, order
        )
        (
            rows.select("y", "features", *([WEIGHT] if WEIGHT in rows.columns else []), batch)
            .withColumn(KEY, F.monotonically_increasing_id())
            .repartition(n, KEY)
            .write.partitionBy(batch)
            .bucketBy(n, KEY)
            .sortBy(KEY)
            .format("parquet")
            .option("path", table.path)
            .saveAsTable(table.name)
        )
        return table

    def rows(self, value: object) -> DataFrame:
        return self.spark.table(self.name).where(F.col(self.batch).eqNullSafe(F.lit(value)))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_directory(self.spark, self.path)


@dataclass
class Versions:
    """States written one directory per step; a step reads one version and writes the next.

    They are tables bucketed by slot, as many buckets as a shuffle has partitions, so a step shuffles its
    gradients alone.
    """

    spark: SparkSession
    base: str
    keep: int | None = 2
    written: list[tuple[str, str]] = field(default_factory=list)

    def write(self, state: DataFrame, version: int) -> DataFrame:
        path, name = f"{self.base}/version={version}", f"clickloom_state_{uuid.uuid4().hex}"
        writer = state.write.bucketBy(shuffle_partitions(self.spark), "idx").sortBy("idx").format("parquet")
        writer.option("path", path).saveAsTable(name)
        self.written.append((path, name))
        if self.keep is not None and len(self.written) > self.keep:
            path, old = self.written.pop(0)
            self.spark.sql(f"DROP TABLE IF EXISTS {old}")
            delete_directory(self.spark, path)
        return self.spark.table(name)


def fit(
    rows: DataFrame,
    batch: str,
    learner: Ftrl | None = None,
    *,
    epochs: int = 2,
    state: DataFrame | None = None,
    step: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    on_step: Callable[[int, int, DataFrame], None] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Fit over the batches of ``rows`` in ascending order of the ``batch`` column, ``epochs`` times.

    Batches are defined by data, never by partition, so the result does not depend on the cluster. The
    driver holds the list of batch values and the plan of one step; every state is written to the shared
    folder, which keeps plans short and lets a step be retried. ``step`` replaces the learner's own step,
    ``on_step`` sees each new state.
    """
    spark = rows.sparkSession
    advance = step or (learner or Ftrl()).step
    table = FeatureTable.write(rows, batch, buckets)
    try:
        versions = Versions(spark, new_path(spark, "ftrl"))
        current = state if state is not None else empty_state(spark)
        number = 0
        for epoch in range(epochs):
            for value in table.batches:
                number += 1
                current = versions.write(advance(current, table.rows(value)), number)
                if on_step:
                    on_step(epoch, number, current)
    finally:
        table.drop()
    return current
