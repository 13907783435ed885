"""AUC, log loss, error rate, accuracy: all from one table of distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalar import log_loss
from clickloom.operators.running import running
from clickloom.options import LearnerOptions


def _ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0))


def score_counts(
    df: DataFrame, label: str, score: str, prediction: str | None = None, weight: str | None = None
) -> DataFrame:
    """Positives, negatives and wrong predictions per distinct score; labels must be 0 or 1.

    Every metric below depends only on these counts, so the rows are scanned and shuffled once, and equal
    scores are collapsed on the map side. With ``weight`` they are sums of that column, and ``held`` always is
    the number of rows.
    """
    share = F.col(weight).cast("double") if weight else F.lit(1)
    y = F.col(label)
    positive = (
        F.when(y == 1, F.lit(1))
        .when(y == 0, F.lit(0))
        .otherwise(
            F.raise_error(F.concat(F.lit("labels must be 0 or 1, found "), y.cast("string"))).cast("int")
        )
    )
    # a missing prediction is a wrong one
    wrong = (~y.eqNullSafe(F.col(prediction))).cast("int") if prediction else F.lit(0)
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(share * positive).alias("pos"),
        F.sum(share * (1 - positive)).alias("neg"),
        F.sum(share * wrong).alias("wrong"),
        F.count(F.lit(1)).alias("held"),
    )


def _pairs_won(neg_upto: Column) -> Column:
    """Positive-negative pairs in the right order for one score, ties counted half."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    return pos * (neg_upto.cast("double") - neg / 2.0)


def _auc() -> Column:
    pairs = F.sum(F.col("pos")).cast("double") * F.sum(F.col("neg")).cast("double")
    return _ratio(F.sum(_pairs_won(F.col("neg_upto"))), pairs)


def auc(df: DataFrame, label: str, score: str, blocks: int | None = None, weight: str | None = None) -> DataFrame:
    """One row (auc, pos, neg): exact, tie-averaged; NULL when a class is missing.

    With ``weight`` a pair of rows counts as the product of their weights, and pos and neg are sums of them.
    """
    counts = score_counts(df, label, score, weight=weight)
    ranked = running(counts, ["score"], sums={"neg_upto": F.col("neg")}, blocks=blocks)
    return ranked.agg(
        _auc().alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("neg"),
    )


def _mean(value: Column, weight: str | None) -> Column:
    if weight is None:
        return F.avg(value)
    return _ratio(F.sum(F.col(weight) * value), F.sum(F.when(value.isNotNull(), F.col(weight))).cast("double"))


def mean_log_loss(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """One row (logloss, rows)."""
    return df.agg(
        _mean(log_loss(F.col(score), F.col(label)), weight).alias("logloss"),
        F.count(F.lit(1)).alias("rows"),
    )


def error_rate(df: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """One row (error_rate, accuracy, errors, rows); a missing prediction is an error.

    With ``weight`` the two rates are shares of it; errors and rows stay numbers of rows.
    """
    wrong = ~F.col(label).eqNullSafe(F.col(prediction))
    errors = F.count_if(wrong)
    rows = F.count(F.lit(1))
    share = _mean(wrong.cast("double"), weight) if weight else _ratio(errors, rows)
    return df.agg(
        share.alias("error_rate"),
        (1 - share).alias("accuracy"),
        errors.alias("errors"),
        rows.alias("rows"),
    )


def base_rate(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """One row (base_rate): the mean label."""
    return df.agg(_mean(F.col(label).cast("double"), weight).alias("base_rate"))


def right_at(threshold: Column, label: Column, score: Column) -> Column:
    """1.0 where the score is on the label's side of the threshold; a score equal to it is right."""
    hit = ((score >= threshold) & (label == 1)) | ((score <= threshold) & (label == 0))
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def accuracy_at(df: DataFrame, label: str, score: str, threshold: DataFrame, weight: str | None = None) -> DataFrame:
    """One row (accuracy, rows) at the threshold held in the one-row, one-column ``threshold``."""
    cut = threshold.scalar()
    return df.agg(
        _mean(right_at(cut, F.col(label), F.col(score)), weight).alias("accuracy"),
        F.count(F.lit(1)).alias("rows"),
    )


def predicted_class(df: DataFrame, score: str, threshold: DataFrame, out: str = "class") -> DataFrame:
    """Class +1 where the score reaches the one-row ``threshold``, else -1."""
    return df.withColumn(
        out, F.when(F.col(score) >= threshold.scalar(), F.lit(1)).otherwise(F.lit(-1))
    )


def report(
    df: DataFrame,
    label: str,
    score: str,
    *,
    prediction: str | None = None,
    threshold: DataFrame | None = None,
    weight: str | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """One row (auc, accuracy, logloss, rows).

    Accuracy is the share of right predictions, or, given a one-row ``threshold``, the share of scores on
    the right side of it. With ``weight`` all three are those of the rows that a row stands for, while rows
    stays the number of rows.
    """
    if (prediction is None) == (threshold is None):
        raise ValueError("give either a prediction column or a threshold")
    ranked = running(
        score_counts(df, label, score, prediction, weight), ["score"], sums={"neg_upto": F.col("neg")}, blocks=blocks
    )
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    total = F.sum(pos + neg)
    if threshold is None:
        right = F.sum(pos + neg - F.col("wrong")).cast("double")
    else:
        cut = threshold.scalar()
        right = F.sum(pos * right_at(cut, F.lit(1), s) + neg * right_at(cut, F.lit(0), s))
    loss = F.sum(pos * log_loss(s, F.lit(1)) + neg * log_loss(s, F.lit(0)))
    return ranked.agg(
        _auc().alias("auc"),
        _ratio(right, total).alias("accuracy"),
        _ratio(loss, total).alias("logloss"),
        F.coalesce(F.sum("held"), F.lit(0)).alias("rows"),
    )


def running_progress(
    df: DataFrame,
    label: str,
    order: list[str],
    *,
    score: str | None = None,
    report_every: int = LearnerOptions.report_every,
    blocks: int | None = None,
) -> DataFrame:
    """Running mean of the label, and with ``score`` the running sum of the log loss, in ``order``.

    Rows are reported at every ``report_every``-th position, the way a progress log is.
    """
    sums = {"labels": F.col(label).cast("double")}
    if score:
        sums["cumulative_loss"] = log_loss(F.col(score), F.col(label))
    ran = running(df, order, sums=sums, number="seq", blocks=blocks)
    return ran.where(F.col("seq") % report_every == 0).select(
        *df.columns,
        "seq",
        (F.col("labels") / F.col("seq")).alias("running_base_rate"),
        *(["cumulative_loss"] if score else []),
    )
