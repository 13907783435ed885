"""The online learner over files: fit, score, classify, submit, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.scalar import LOGISTIC, Loss
from clickloom.operators import ftrl, metrics
from clickloom.operators.splits import sample_negatives
from clickloom.operators.vectorize import OneHotIndex, positional_columns, vectorize_named, vectorize_positional
from clickloom.options import ColumnRoles, FtrlParams, LearnerOptions
from clickloom.session import write_table
from clickloom.sources.records import PLACE, numbered, read_lines_in_place
from clickloom.sources.sinks import write_submission
from clickloom.sources.text import read_by_name, split_fields

# steps of an epoch: each learns this share of the log, whatever its size
STEPS = 32

# places of a score that tell rows apart; sums in another order differ behind them
TIED = 12


@dataclass
class OnlineLearner:
    """FTRL over headered CSV (columns by name) or headerless comma text (columns by position).

    Rows are learned in the order of their files (files by name), in ``batches`` steps an epoch: each takes
    the next run of rows, of the same length whatever the size of the log, so ids may repeat or be missing.
    Where the log has a column for it, ``batch`` orders the steps instead.
    """

    spark: SparkSession
    roles: ColumnRoles
    params: FtrlParams = FtrlParams()
    options: LearnerOptions = LearnerOptions()
    loss: Loss = LOGISTIC
    batches: int = STEPS
    batch: str | None = None
    step: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    state: DataFrame | None = None
    index: OneHotIndex | None = field(default=None, repr=False)

    @property
    def learner(self) -> ftrl.Ftrl:
        hashed = self.options.max_features + len(self.roles.numeric)
        slots = hashed if self.index is None else self.index.slots
        return ftrl.Ftrl(self.params, self.loss, slots)

    # ---- fitting

    def fit_csv(self, path: str) -> OnlineLearner:
        log = self._csv(path)
        if not self.options.hash_trick:
            self.index = self.index.refit(log) if self.index else OneHotIndex.fit(log, self.roles)
        return self._fit(self._named(log, [self.batch] if self.batch else PLACE))

    def fit_file(self, path: str) -> OnlineLearner:
        lines = self._lines(path)
        if not self.options.hash_trick:
            columns = positional_columns(lines, "fields", self.roles)
            self.index = self.index.refit(columns) if self.index else OneHotIndex.fit(columns, self.roles, positional=True)
        return self._fit(self._positional(lines, PLACE))

    def _fit(self, rows: DataFrame) -> OnlineLearner:
        if self.batch:
            if self.options.keep_negatives < 100:
                raise ValueError("sampling of negatives needs rows numbered in file order, so no batch column")
            rows = rows.withColumnRenamed(self.batch, "batch")
        else:
            # the place depends on how files are split, the number does not
            rows = numbered(write_table(rows, "rows"), "_number")
            if self.options.keep_negatives < 100:
                # rows are drawn by number, since ids may repeat; steps stay runs of the whole log
                rows = write_table(sample_negatives(rows, "y", "_number", self.options.keep_negatives), "sampled-rows")
            last = rows.agg(F.max("_number")).first()[0]
            per_step = max(1, -(-((last or 0) + 1) // self.batches))
            rows = rows.withColumn("batch", F.expr(f"int(_number div {per_step})")).drop("_number")
        self.state = ftrl.fit(
            rows, "batch", self.learner, epochs=self.options.epochs, state=self.state, step=self.step
        )
        return self

    # ---- using the model

    def predict_probability(self, path: str) -> DataFrame:
        """(id, probability) of every row of a headered CSV; the target column may be missing."""
        scores = self.learner.score(self._named(self._csv(path)), self._fitted())
        return scores.withColumnRenamed("row_id", "id")

    def predict_class(self, path: str) -> DataFrame:
        """(id, class): +1 where the probability reaches the base rate seen in fitting, else -1."""
        cut = self.base_rate()
        return metrics.predicted_class(self.predict_probability(path), "probability", cut).select("id", "class")

    def write_submission(self, path: str, out: str, *, single_file: bool = False) -> None:
        """Write ``id,click`` for a headered CSV, in the order of its rows."""
        rows = self._named(self._csv(path), PLACE)
        scored = write_table(self.learner.labelled_scores(rows, self._fitted(), ["row_id", *PLACE]), "scores")
        write_submission(numbered(scored, "number"), out, number="number", single_file=single_file)

    def evaluate_csv(self, path: str) -> DataFrame:
        return self._evaluate(self._named(self._csv(path)))

    def evaluate_file(self, path: str) -> DataFrame:
        return self._evaluate(self._positional(self._lines(path)))

    def _evaluate(self, rows: DataFrame) -> DataFrame:
        """One row (auc, accuracy at the base rate, logloss, rows).

        Rows with the same features tie, whatever the order in which their cells were added: scores are rounded
        to ``TIED`` places.
        """
        scored = self.learner.labelled_scores(rows, self._fitted())
        scored = scored.withColumn("probability", F.round("probability", TIED))
        return metrics.report(scored, "y", "probability", threshold=self.base_rate())

    def base_rate(self) -> DataFrame:
        """One row (base_rate): the mean label over all epochs."""
        return ftrl.progress_of(self._fitted()).select("base_rate")

    # ---- rows

    def _fitted(self) -> DataFrame:
        if self.state is None:
            raise ValueError("fit the learner first")
        return self.state

    def _csv(self, path: str) -> DataFrame:
        log = read_by_name(self.spark, path, place=True)
        if self.roles.target not in log.columns:
            log = log.withColumn(self.roles.target, F.lit(None).cast("int"))
        return log

    def _named(self, log: DataFrame, keep: list[str] | None = None) -> DataFrame:
        if self.index is not None:
            return self.index.transform(log, keep or [])
        return vectorize_named(log, self.roles, self.options, keep or [])

    def _lines(self, path: str) -> DataFrame:
        lines = split_fields(read_lines_in_place(self.spark, path))
        # rows of a bare file have no id
        return lines.withColumn(self.roles.id, F.lit(None).cast("string"))

    def _positional(self, lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if self.index is not None:
            columns = positional_columns(lines, "fields", self.roles, PLACE)
            return self.index.transform(columns, keep)
        return vectorize_positional(lines, "fields", self.roles, self.options, keep)
