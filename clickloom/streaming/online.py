"""Online learning and scoring over Structured Streaming micro-batches.

A micro-batch is one learning step: it reads the state version that its batch id names and writes the
next one, overwriting whatever a failed attempt left there. A batch that is delivered twice therefore
changes nothing. Order is batch order; there are no event-time semantics, hence no watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from clickloom.operators.ftrl import KEY, STATE, Ftrl, empty_state, progress_of
from clickloom.session import delete_directory, new_path, path_exists, write_table


@dataclass(frozen=True)
class OnlineModel:
    """A folder of state versions; a stream that begins at version v has state v + b before micro-batch b.

    A new folder begins with ``initial``, a state fitted before, or with the empty one. ``keep`` is the number of versions to retain, at least 2: a repeated micro-batch still needs the
    version it started from. The progress of every micro-batch is kept in one-row tables of its own.
    """

    spark: SparkSession
    folder: str
    keep: int = 2
    initial: DataFrame | None = None

    def _state_path(self, version: int) -> str:
        return f"{self.folder}/states/version={version}"

    def state(self, version: int) -> DataFrame:
        if version == 0:
            return empty_state(self.spark) if self.initial is None else self.initial
        return self.spark.read.schema(STATE).parquet(self._state_path(version))

    def latest_version(self) -> int:
        """The newest version that has been written, 0 for none."""
        done = [r["version"] for r in self.progress().orderBy(F.desc("version")).limit(1).collect()] if self._begun() else []
        return done[0] if done else 0

    def latest(self) -> DataFrame:
        return self.state(self.latest_version())

    def _begun(self) -> bool:
        return path_exists(self.spark, f"{self.folder}/progress")

    def base(self, checkpoint: str) -> int:
        """The version that a checkpoint's stream began with: the newest one when the checkpoint was new."""
        mark = f"{self.folder}/bases/{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex}"
        if not path_exists(self.spark, mark):
            self.spark.range(1).selectExpr(f"{self.latest_version()} AS version").write.parquet(mark)
        return self.spark.read.schema("version int").parquet(mark).first()[0]

    def store(self, state: DataFrame, version: int) -> None:
        """Write a version and its progress, replacing an earlier attempt, and drop versions out of use."""
        state.write.mode("overwrite").parquet(self._state_path(version))
        now = progress_of(self.state(version)).select("rows", "label_sum", "loss_sum")
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/progress/version={version}")
        if version > self.keep:
            delete_directory(self.spark, self._state_path(version - self.keep))

    def progress(self) -> DataFrame:
        """One row per finished micro-batch: version and the running rows, label sum and loss sum."""
        schema = "rows bigint, label_sum double, loss_sum double, version int"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/progress")


def start(
    writer: DataStreamWriter, checkpoint: str, available_now: bool, wait: bool
) -> StreamingQuery:
    query = (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**({"availableNow": True} if available_now else {"processingTime": "0 seconds"}))
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


def fit_stream(
    rows: DataFrame,
    model: OnlineModel,
    checkpoint: str,
    learner: Ftrl,
    *,
    step: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    available_now: bool = True,
    wait: bool = True,
) -> StreamingQuery:
    """Learn from a stream of sparse rows (row_id, y, features): predict, then update, per micro-batch."""
    advance = step or learner.step
    base = model.base(checkpoint)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # the step needs the rows twice; the source and the vectorizer should run once
        path = new_path(batch.sparkSession, "micro-batch")
        rows = write_table(batch.withColumn(KEY, F.monotonically_increasing_id()), "micro-batch", path)
        try:
            model.store(advance(model.state(base + batch_id), rows), base + batch_id + 1)
        finally:
            delete_directory(batch.sparkSession, path)

    return start(rows.writeStream.foreachBatch(one_batch), checkpoint, available_now, wait)


def score_stream(
    rows: DataFrame,
    state: DataFrame,
    out: str,
    checkpoint: str,
    learner: Ftrl,
    *,
    available_now: bool = True,
    wait: bool = True,
) -> StreamingQuery:
    """Score a stream of sparse rows with a fixed model; each micro-batch replaces its own directory."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        learner.score(batch, state).write.mode("overwrite").parquet(f"{out}/micro_batch={batch_id}")

    return start(rows.writeStream.foreachBatch(one_batch), checkpoint, available_now, wait)
