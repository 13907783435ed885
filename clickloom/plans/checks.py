"""Registered queries whose results SQL can state although it cannot train: trees, splits, the file learner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import ftrl, metrics, splits, trees
from clickloom.operators.counts import CountEncoder
from clickloom.options import BoostingParams, ColumnRoles, LearnerOptions
from clickloom.plans.ctr import TwoStageModel, two_stage
from clickloom.plans.learner import OnlineLearner
from clickloom.session import new_path, write_table
from clickloom.sources.sinks import write_csv, write_lines
from clickloom.sources.tables import EVENT_FEATURES, EVENT_ROLES, click_events, click_log_csv
from clickloom.sources.text import CLICK_LOG_FEATURES, CLICK_LOG_LABEL, join_fields, read_click_log

TOLERANCE = 1e-9

# steps of an epoch where the log itself does not name them
ORDERED_STEPS = 4


def gbdt_consistency(spark: SparkSession, sf_dir: str, encoded: DataFrame, inputs: list[str]) -> DataFrame:
    """Rows, and how many of them disagree with the trained trees read as a table of nodes.

    Leaves are routed again by the exported trees, probabilities computed again from the raw score, leaf
    slots held against the widths, and the widths against the node counts.
    """
    train, _ = splits.hash_split(encoded, "event_id")
    fitted = trees.BoostedTrees.fit(train, inputs, "click", BoostingParams())
    scored = write_table(fitted.transform(encoded), "boosted")
    exported = fitted.ensemble()
    widths = fitted.leaf_counts
    slots = trees.leaf_slots(F.col("leaf_positions"), widths)
    routed = F.array(*[exported.leaf(t).cast("int") for t in range(len(exported.trees))])
    again = 1 / (1 + F.exp(-2 * F.col("raw_score")))
    nodes = fitted.nodes().groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("left") < 0).alias("leaves")
    )
    wrong_width = nodes.where("leaves <> (nodes + 1) / 2").count()
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(routed != F.col("leaf_positions")).alias("other_leaves"),
        F.count_if(F.abs(F.col("probability") - again) > TOLERANCE).alias("other_probabilities"),
        F.count_if(
            F.exists(F.zip_with(slots, F.lit(_ends(widths)), lambda s, end: (s < 0) | (s >= end)), lambda b: b)
        ).alias("slots_out_of_range"),
        F.lit(wrong_width).cast("bigint").alias("wrong_widths"),
    )


def _ends(widths: list[int]) -> list[int]:
    return [sum(widths[: k + 1]) for k in range(len(widths))]


def random_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any seed: rows, rows in both parts, and whether the share is near 70%."""
    log = click_events(spark, sf_dir).select("event_id")
    train, test = splits.random_split(log)
    both = train.withColumn("train", F.lit(1)).unionByName(test.withColumn("train", F.lit(0)))
    per_row = both.groupBy("event_id").agg(F.count(F.lit(1)).alias("times"), F.sum("train").alias("trained"))
    share = F.sum("trained") / F.sum("times")
    return per_row.agg(
        F.sum("times").alias("rows"),
        F.count_if(F.col("times") > 1).alias("repeated"),
        (F.abs(share - 0.7) < 5 * F.sqrt(0.21 / F.sum("times"))).cast("int").alias("near_share"),
    )


def two_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stage the held-out rows, and whether its metrics are in range and its AUC is that of its scores."""
    return _stages_checked(two_stage(click_events(spark, sf_dir), EVENT_FEATURES, "click", "event_id", "batch"))


def _stages_checked(fitted: TwoStageModel) -> DataFrame:
    stages = {
        "boosted_trees": fitted.held_out(fitted.tree_scores).select("y", "probability"),
        "ftrl_on_leaves": fitted.ftrl_scores().select("y", "probability"),
    }
    reports = {r["stage"]: r for r in fitted.report().collect()}
    out = None
    for stage, scores in stages.items():
        r = reports[stage]
        ranked = metrics.auc(write_table(scores, "scores"), "y", "probability")
        row = ranked.select(
            F.lit(stage).alias("stage"),
            (F.col("pos") + F.col("neg")).alias("rows"),
            (
                F.lit(0 <= r["auc"] <= 1 and 0 <= r["accuracy"] <= 1 and r["logloss"] > 0)
                & (F.abs(F.col("auc") - r["auc"]) < TOLERANCE)
            ).cast("int").alias("sound"),
        )
        out = row if out is None else out.union(row)
    return out


def click_log_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24-column click log from its CSV: 23 features in 46 slots, fitted on the training part."""
    path = new_path(spark, "click-log")
    click_log_csv(spark, sf_dir, path)
    log = read_click_log(spark, path)
    train, _ = splits.hash_split(log, "id")
    encoder = CountEncoder.fit(train, CLICK_LOG_FEATURES, CLICK_LOG_LABEL)
    return encoder.transform(log).select("id", CLICK_LOG_LABEL, *encoder.slots)


def click_log_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages over the 24-column click log, steps by hour: the checks of ``two_stage_counts``."""
    path = new_path(spark, "click-log")
    click_log_csv(spark, sf_dir, path)
    log = read_click_log(spark, path).withColumn("part", F.expr("int(hour) div 6"))
    return _stages_checked(two_stage(log, CLICK_LOG_FEATURES, CLICK_LOG_LABEL, "id", "part"))


def learner_csv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file learner end to end: events as CSV, two epochs over their batches, scores by name."""
    path = new_path(spark, "learner-csv")
    log = click_events(spark, sf_dir).select("event_id", "click", "hour", "user_id", "k", "batch")
    write_csv(log, path)
    learner = OnlineLearner(spark, EVENT_ROLES, batch="batch").fit_csv(path)
    return learner.predict_probability(path)


def learner_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, log loss and AUC of the file learner on its own file."""
    path = new_path(spark, "learner-csv")
    write_csv(click_events(spark, sf_dir).select("event_id", "click", "hour", "user_id", "k", "batch"), path)
    learner = OnlineLearner(spark, EVENT_ROLES, batch="batch").fit_csv(path)
    return learner.evaluate_csv(path).select("rows", "logloss", "auc")


def learner_csv_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of the file learner on a CSV that names no steps and whose ids are all the same."""
    path = new_path(spark, "learner-csv")
    log = click_events(spark, sf_dir).orderBy("event_id")
    write_csv(log.select(F.lit("same").alias("event_id"), "click", "hour", "user_id", "k"), path)
    return ftrl.model_of(OnlineLearner(spark, EVENT_ROLES, batches=ORDERED_STEPS).fit_csv(path).state)


def event_lines(spark: SparkSession, sf_dir: str) -> str:
    """Path of headerless lines label,hour,user,k in order of the events."""
    path = new_path(spark, "learner-lines")
    line = join_fields(F.col("click"), F.col("hour"), F.col("user_id"), F.col("k"))
    write_lines(click_events(spark, sf_dir).orderBy("event_id").select(line.alias("value")), path)
    return path


LINE_ROLES = ColumnRoles("0", "id", (), ("1", "2", "3"))


def learner_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, log loss and AUC of the learner on a headerless file, learned in the file's order."""
    path = event_lines(spark, sf_dir)
    learner = OnlineLearner(spark, LINE_ROLES, batches=ORDERED_STEPS).fit_file(path)
    return learner.evaluate_file(path).select("rows", "logloss", "auc")


def learner_file_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of the learner on a headerless file without hashing, fitted on it twice."""
    path = event_lines(spark, sf_dir)
    options = LearnerOptions(hash_trick=False, epochs=1)
    learner = OnlineLearner(spark, LINE_ROLES, options=options, batches=ORDERED_STEPS)
    return ftrl.model_of(learner.fit_file(path).fit_file(path).state)
