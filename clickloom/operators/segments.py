"""Record-at-a-time FTRL in exact order, one independent model per segment.

Within a segment the order of the records matters, so they are learned one after the other, as a stream: the
rows of a segment come to its task sorted, in Arrow batches, and only the batch at hand and the segment's model
are held. One shuffle brings all segments into order; nothing is written in between. A segment's own stream
is sequential by nature, however large the segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalar import MARGIN_CLIP, PROBABILITY_CLIP
from clickloom.operators.ftrl import WEIGHT
from clickloom.options import FtrlParams, LearnerOptions
from clickloom.session import shuffle_partitions


@dataclass(frozen=True)
class RecordLoss:
    """``functions.scalar.Loss`` for one record at a time: numbers and numpy arrays instead of columns."""

    link: Callable[[float], float]
    gradient: Callable[[float, float, np.ndarray], np.ndarray]
    cost: Callable[[float, float], float]


def _sigmoid(margin: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(margin, -MARGIN_CLIP), MARGIN_CLIP)))


def _log_loss(p: float, y: float) -> float:
    p = min(max(p, PROBABILITY_CLIP), 1.0 - PROBABILITY_CLIP)
    return -np.log(p) if y == 1 else -np.log(1.0 - p)


LOGISTIC_RECORDS = RecordLoss(link=_sigmoid, gradient=lambda p, y, x: (p - y) * x, cost=_log_loss)


class _Model:
    """State of one segment; slots get places in order of their first record."""

    def __init__(self, params: FtrlParams, loss: RecordLoss) -> None:
        self.params, self.loss = params, loss
        self.places: dict[int, int] = {}
        self.z, self.n = np.zeros(64), np.zeros(64)

    def learn(self, idx: np.ndarray, x: np.ndarray, y: float, weight: float) -> float:
        """The prediction for a record, before the model is updated with it."""
        p = self.params
        at = np.array([self.places.setdefault(i, len(self.places)) for i in idx.tolist()], dtype=np.int64)
        if len(self.places) > len(self.z):
            more = np.zeros(len(self.places))
            self.z, self.n = np.concatenate([self.z, more]), np.concatenate([self.n, more])
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0.0)
        w = -shrunk / (p.l2 + (p.beta + np.sqrt(n)) / p.alpha)
        predicted = self.loss.link(float(w @ x))
        g = weight * self.loss.gradient(predicted, y, x)
        grown = n + g * g
        self.z[at] = z + g - (np.sqrt(grown) - np.sqrt(n)) / p.alpha * w
        self.n[at] = grown
        return predicted


def _records(batch: pd.DataFrame) -> Iterator[tuple]:
    weight = batch[WEIGHT] if WEIGHT in batch.columns else np.ones(len(batch))
    return zip(batch["idx"], batch["x"], batch["y"], weight, strict=True)


def _key(batch: pd.DataFrame, segment: str) -> object:
    key = batch[segment].iloc[0]
    return None if pd.isna(key) else key


def _in_order(rows: DataFrame, segment: str, order: str) -> DataFrame:
    """Records of each segment together and sorted; rows without a segment are a segment of their own."""
    flat = rows.select(
        segment,
        order,
        "y",
        *([WEIGHT] if WEIGHT in rows.columns else []),
        F.transform("features", lambda c: c["idx"]).alias("idx"),
        F.transform("features", lambda c: c["x"]).alias("x"),
    )
    tasks = shuffle_partitions(rows.sparkSession)
    return flat.repartition(tasks, segment).sortWithinPartitions(segment, order)


def _key_field(rows: DataFrame, column: str) -> str:
    return f"`{column}` {rows.schema[column].dataType.simpleString()}"


def fit_by_segment(
    rows: DataFrame,
    segment: str,
    order: str,
    params: FtrlParams = FtrlParams(),
    loss: RecordLoss = LOGISTIC_RECORDS,
) -> DataFrame:
    """Final state (segment, idx, z, n) of every segment of the sparse rows (segment, order, y, features).

    ``order`` must be unique within a segment; a slot may occur once per row. A column ``weight`` counts, and
    rows without a segment are a segment of their own.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, key = _Model(params, loss), None
        for batch in batches:
            key = _key(batch, segment)
            for idx, x, y, weight in _records(batch):
                model.learn(idx, x, y, weight)
        held = len(model.places)
        yield pd.DataFrame(
            {segment: [key] * held, "idx": np.array(list(model.places), np.int32), "z": model.z[:held], "n": model.n[:held]}
        )

    schema = f"{_key_field(rows, segment)}, idx int, z double, n double"
    return _in_order(rows, segment, order).groupBy(segment).applyInPandas(learn, schema)


def progress_by_segment(
    rows: DataFrame,
    segment: str,
    order: str,
    params: FtrlParams = FtrlParams(),
    loss: RecordLoss = LOGISTIC_RECORDS,
    *,
    report_every: int = LearnerOptions.report_every,
) -> DataFrame:
    """The learner's log: (segment, order, seq, probability, running_base_rate, cumulative_loss).

    The probability is that before the record's own update, the mean label and the sum of the loss run from the
    segment's first record up to it; a weight counts in both. Every ``report_every``-th record is reported.
    """

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seq, held, labels, lost = _Model(params, loss), 0, 0.0, 0.0, 0.0
        for batch in batches:
            kept, told = [], []
            for k, (idx, x, y, weight) in enumerate(_records(batch)):
                p = model.learn(idx, x, y, weight)
                seq, held, labels, lost = seq + 1, held + weight, labels + weight * y, lost + weight * loss.cost(p, y)
                if seq % report_every == 0:
                    kept.append(k)
                    told.append((seq, p, labels / held if held else None, lost))
            out = batch[[segment, order]].iloc[kept].reset_index(drop=True)
            names = ["seq", "probability", "running_base_rate", "cumulative_loss"]
            yield pd.concat([out, pd.DataFrame(told, columns=names)], axis=1)

    schema = (
        f"{_key_field(rows, segment)}, {_key_field(rows, order)}, seq bigint, probability double, "
        "running_base_rate double, cumulative_loss double"
    )
    return _in_order(rows, segment, order).groupBy(segment).applyInPandas(learn, schema)
