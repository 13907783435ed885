"""The two-stage job: count encoding, boosted trees, leaf features, FTRL, and a report of both stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalar import LOGISTIC, Loss
from clickloom.operators import metrics
from clickloom.operators.counts import CountEncoder
from clickloom.operators.ftrl import KEY, Ftrl, fit, keyed, progress_of
from clickloom.operators.splits import in_training
from clickloom.operators.trees import BoostedTrees, leaf_cells, leaf_line, leaf_slots
from clickloom.options import MIN_SUPPORT, BoostingParams, FtrlParams, LearnerOptions
from clickloom.session import write_table


@dataclass(frozen=True)
class TwoStageModel:
    """Everything the job learned, and its scored rows."""

    encoder: CountEncoder
    trees: BoostedTrees
    state: DataFrame
    learner: Ftrl
    tree_scores: DataFrame
    leaf_rows: DataFrame

    def held_out(self, df: DataFrame) -> DataFrame:
        return df.where(~F.col("is_train"))

    def leaf_lines(self, train: bool) -> DataFrame:
        """The leaf features of the training or the held-out rows as comma lines."""
        rows = self.tree_scores.where(F.col("is_train") == train)
        line = leaf_line(F.col("y"), F.col("leaf_positions"), self.trees.leaf_counts)
        return rows.select(line.alias("value"))

    def ftrl_scores(self) -> DataFrame:
        """Held-out rows (row_id, y, probability) scored by the second stage."""
        rows = self.held_out(self.leaf_rows).select(KEY, "row_id", "y", "features")
        return self.learner.labelled_scores(rows, self.state)

    def report(self) -> DataFrame:
        """One row per stage (stage, auc, accuracy, logloss, rows) on the held-out rows."""
        trees = metrics.report(
            self.held_out(self.tree_scores), "y", "probability", prediction="prediction"
        )
        ftrl = metrics.report(
            self.ftrl_scores(),
            "y",
            "probability",
            threshold=progress_of(self.state).select("base_rate"),
        )
        return trees.select(F.lit("boosted_trees").alias("stage"), "*").unionByName(
            ftrl.select(F.lit("ftrl_on_leaves").alias("stage"), "*")
        )


def two_stage(
    log: DataFrame,
    columns: Sequence[str],
    label: str,
    row_key: str,
    batch: str,
    *,
    boosting: BoostingParams = BoostingParams(),
    ftrl: FtrlParams = FtrlParams(),
    loss: Loss = LOGISTIC,
    options: LearnerOptions = LearnerOptions(),
    fit_on: str = "train",
    min_support: int = MIN_SUPPORT,
) -> TwoStageModel:
    """Run both stages on a log with a unique ``row_key`` and a ``batch`` column that orders learning.

    ``fit_on="all"`` takes the count statistics from all rows, held-out labels included, as the original
    job did; the default keeps them out. ``loss`` is that of the second stage; its link has to give
    probabilities for the report.
    """
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on is 'train' or 'all'")
    train = in_training(F.col(row_key))
    encoder = CountEncoder.fit(log.where(train) if fit_on == "train" else log, columns, label, min_support)
    # encoded once; training, scoring and leaf features all read this table
    encoded = write_table(
        encoder.transform(log).select(
            F.col(row_key).alias("row_id"),
            F.col(label).cast("double").alias("y"),
            F.col(batch).alias("batch"),
            train.alias("is_train"),
            *encoder.slots,
        ),
        "encoded",
    )
    trees = BoostedTrees.fit(encoded.where("is_train"), encoder.slots, "y", boosting)
    scores = write_table(
        trees.transform(encoded).select(
            "row_id", "y", "batch", "is_train", "probability", "prediction", "leaf_positions"
        ),
        "tree-scores",
    )
    slots = leaf_slots(F.col("leaf_positions"), trees.leaf_counts)
    # leaf features are written once, numbered, for both fitting and scoring
    rows = keyed(
        scores.select(
            "row_id",
            "y",
            "batch",
            "is_train",
            leaf_cells(slots, trees.leaf_counts, options.max_features).alias("features"),
        )
    )
    learner = Ftrl(ftrl, loss, slots=options.max_features)
    state = fit(rows.where("is_train"), "batch", learner, epochs=options.epochs)
    return TwoStageModel(encoder, trees, state, learner, scores, rows)
