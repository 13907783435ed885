"""FTRL-proximal logistic regression over hashed text features, shared by the text classifiers.

Fitting takes a bounded sample of labelled rows, featurized by Spark tasks; only indices and values reach
the fit. Scoring is a sparse dot product per text against the broadcast weights, inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.tables import text_batches
from clickloom.llm.words import pieces, release, tidy

# tasks that featurize a sample
_PARTS = 16

# (bytes, offsets) of a run of texts -> (hashes of all features, text number of each)
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Sample:
    """What a fit may take: at most ``rows`` labelled rows with texts of at most ``text_bytes`` each.

    Ids with the smallest hashes are chosen; where their rows are more, since ids repeat, the rows with the
    smallest hashes of id and text.
    """

    rows: int = 8_000
    seed: int = 11
    text_bytes: int = 1 << 17


@dataclass(frozen=True)
class Ftrl:
    """Hyper-parameters; ``bits`` gives 2^bits coordinates, of which the first is the intercept."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1e-3
    epochs: int = 4
    bits: int = 20


@dataclass(frozen=True)
class Weights:
    """The non-zero weights of a fit, at most 2^bits of them."""

    bits: int
    index: np.ndarray
    value: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.value
        return out


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Coordinates 1 .. 2^bits - 1; 0 is the intercept."""
    return (hashes % np.uint64((1 << bits) - 1)).astype(np.int64) + 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def counted(features: Features, damp: Callable, bits: int, data: np.ndarray, offsets: np.ndarray, keep=None):
    """(text, coordinate, value) of every distinct coordinate of each text, sorted by text.

    ``damp(count, total)`` turns a coordinate's count and the number of all features of its text into the
    value. ``keep`` drops coordinates whose weight is zero before they are sorted; totals stay the same.
    """
    hashes, text = features(data, offsets)
    total = np.bincount(text, minlength=len(offsets) - 1)
    at = slots(hashes, bits)
    if keep is not None:
        hit = keep[at]
        at, text = at[hit], text[hit]
    key = np.sort((text.astype(np.int64) << bits) | at)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(key)]]))
    text = key[first] >> bits
    return text, key[first] & ((1 << bits) - 1), damp(count, total[text])


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, sample: Sample) -> DataFrame:
    """(doc_id, y) of at most ``sample.rows`` labelled rows; rows without id or label are left out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where("doc_id IS NOT NULL AND y IN (0, 1)")
    return known.orderBy(F.xxhash64("doc_id", F.lit(sample.seed)), "doc_id", "y").limit(sample.rows)


def fit(
    docs: DataFrame, labels: DataFrame, label: str, features: Features, damp: Callable, ftrl: Ftrl, sample: Sample
) -> Weights:
    """Learn from the sample in the order of hashed ids, which does not depend on the cluster."""
    chosen = F.broadcast(sample_rows(docs, labels, label, sample))  # at most sample.rows rows
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = ftrl.bits

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column(2)):
                text, at, x = counted(features, damp, bits, data, offsets)
                ends = np.searchsorted(text, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        batch.column(1).slice(first, end - first),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.float32))),
                    ],
                    ["doc_id", "y", "at", "x"],
                )

    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= sample.text_bytes
    matches = texts.where(short).join(chosen, "doc_id").select("doc_id", "y", "text")
    # ids may stand for any number of rows, so the bound holds for what the join gives
    rows = matches.orderBy(F.xxhash64("doc_id", "y", "text"), "doc_id", "y", "text").limit(sample.rows).repartition(_PARTS)
    table = text_batches(rows).mapInArrow(tidy(featurize), "doc_id bigint, y int, at array<int>, x array<float>").toArrow()
    examples = [
        # views of what Arrow holds: widened one example at a time
        (i, y, np.asarray(a.values), np.asarray(x.values))
        for i, y, a, x in zip(
            table["doc_id"].to_pylist(), table["y"].to_pylist(), table["at"], table["x"], strict=True
        )
    ]
    examples.sort(key=lambda e: (hash((e[0], ftrl.bits, sample.seed)), e[0], e[1], len(e[2]), e[2].tobytes()))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(ftrl.epochs):
        for _, y, at, x in examples:
            update(z, n, np.append(at, 0), np.append(x, 1.0), y, ftrl)
    w = weights(z, n, ftrl)
    index = np.flatnonzero(w)
    del table, examples, z, n
    release()
    return Weights(bits, index, w[index].astype(np.float32))


def weights(z: np.ndarray, n: np.ndarray, ftrl: Ftrl) -> np.ndarray:
    """Closed-form weights: exactly zero while |z| <= l1, with a rate of its own per coordinate."""
    shrunk = np.sign(z) * ftrl.l1 - z
    return np.where(np.abs(z) <= ftrl.l1, 0.0, shrunk / ((ftrl.beta + np.sqrt(n)) / ftrl.alpha + ftrl.l2))


def update(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, y: int, ftrl: Ftrl) -> None:
    """One follow-the-regularized-leader update with one example; coordinates must not repeat."""
    zi, ni = z[at], n[at]
    w = weights(zi, ni, ftrl)
    g = (sigmoid(w @ x) - y) * x
    more = ni + g * g
    z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ftrl.alpha * w
    n[at] = more


def score(docs: DataFrame, model: Weights, features: Features, damp: Callable, out: str) -> DataFrame:
    """``docs`` with every column kept and the probability of label 1 added as ``out``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2^bits pairs
    column = docs.columns.index("text")
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.dense()
        keep = w != 0
        for batch in batches:
            margin = np.full(batch.num_rows, float(w[0]))
            for first, end, data, offsets in pieces(batch.column(column)):
                text, at, x = counted(features, damp, bits, data, offsets, keep)
                margin[first:end] += np.bincount(text, w[at].astype(np.float64) * x, minlength=end - first)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sigmoid(margin))], [*batch.schema.names, out]
            )

    return text_batches(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front where the table has such a column."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
