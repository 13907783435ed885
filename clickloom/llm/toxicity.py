"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, pairs of neighbours, and pairs with one or two words between them. A feature counts
once per text, so one word weighs the same in a short text and in a long one. Every coordinate has its own
rate, and the L1 term leaves few weights: what is broadcast is a short list of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import sparse_ftrl
from clickloom.llm.words import ALNUM, combine, hash_words

# documents of this remainder are held out
FOLDS, HELD_OUT = 5, 0

SKIPS = (1, 2, 3)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of words, bigrams and skip-grams."""
    words, firsts = hash_words(data, offsets, ALNUM)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    out, where = [words], [text]
    for gap in SKIPS:
        n = len(words) - gap
        if n > 0:
            inside = text[:n] == text[gap:]
            pairs = combine(np.full(n, gap, np.uint64), words[:n], words[gap:])
            out.append(pairs[inside])
            where.append(text[:n][inside])
    return np.concatenate(out), np.concatenate(where)


def damp(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.ones(len(count))


def held_out(key: str = "doc_id"):
    """Whether labels of this document must not be learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class ToxicityClassifier:
    """Learns ``labels.toxic`` of the folds that are not held out, from at most ``sample.rows`` rows."""

    ftrl: sparse_ftrl.Ftrl = field(default_factory=lambda: sparse_ftrl.Ftrl(alpha=1.0, l1=3.0))
    sample: sparse_ftrl.Sample = sparse_ftrl.Sample(rows=8_000)
    threshold: float = 0.5

    def fit(self, docs: DataFrame, labels: DataFrame) -> sparse_ftrl.Weights:
        known = labels.where(~held_out())
        return sparse_ftrl.fit(docs, known, "toxic", features, damp, self.ftrl, self.sample)

    def score(self, docs: DataFrame, model: sparse_ftrl.Weights, out: str = "score") -> DataFrame:
        """``docs`` with the probability of toxicity added; null and empty texts get the intercept's."""
        return sparse_ftrl.score(docs, model, features, damp, out)

    def classify(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """One row per document: doc_id, held_out, score, predicted (1 from the threshold on).

        Without any labels of use every score is 0.5. Null ids are scored as well and never held out.
        Repeated labels are learned as often as they stand; other columns of either table are ignored.
        """
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        scored = self.score(texts, self.fit(docs, labels))
        return scored.select(
            "doc_id",
            held_out().alias("held_out"),
            "score",
            (F.col("score") >= self.threshold).cast("int").alias("predicted"),
        )
