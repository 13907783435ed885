"""Scalar column functions: links, losses, gradient, sign."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: margin clip of the sigmoid and probability clip of the log loss
MARGIN_CLIP = 35.0
PROBABILITY_CLIP = 1e-14


def sigmoid(margin: Column) -> Column:
    """1 / (1 + e^-m) with the margin clipped to [-35, 35]; NULL for NULL."""
    clipped = F.greatest(F.least(margin, F.lit(MARGIN_CLIP)), F.lit(-MARGIN_CLIP))
    return F.when(margin.isNotNull(), 1.0 / (1.0 + F.exp(-clipped)))


def boosting_probability(raw: Column) -> Column:
    """Probability of class 1 for a boosted ensemble trained on log loss: 1 / (1 + e^-2F)."""
    return 1.0 / (1.0 + F.exp(-2.0 * raw))


def log_loss(probability: Column, label: Column) -> Column:
    """Log loss of one row, always on the clipped probability, so 0 and 1 stay finite."""
    p = F.greatest(F.least(probability, F.lit(1.0 - PROBABILITY_CLIP)), F.lit(PROBABILITY_CLIP))
    return F.when(label == 1, -F.log(p)).otherwise(-F.log(1.0 - p))


def logistic_gradient(probability: Column, label: Column, x: Column) -> Column:
    """Derivative of the log loss by the weight of a feature with value x."""
    return (probability - label) * x


def sign_plus(value: Column) -> Column:
    """Sign with sign(0) = +1."""
    return F.when(value >= 0, F.lit(1)).otherwise(F.lit(-1))


@dataclass(frozen=True)
class Loss:
    """The three column functions that turn the linear learner into a particular model."""

    link: Callable[[Column], Column]
    gradient: Callable[[Column, Column, Column], Column]
    cost: Callable[[Column, Column], Column]


LOGISTIC = Loss(link=sigmoid, gradient=logistic_gradient, cost=log_loss)
