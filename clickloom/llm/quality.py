"""Document quality: logistic regression over hashed word n-grams, trained with FTRL updates.

Besides the word itself every word has a shape: its runs of capitals, other letters and digits as one sign
each, punctuation as it stands, and a mark of its own if it repeats the word before. Unigrams and bigrams
of words and one- to three-grams of shapes are hashed into one space. A text's value of a feature is the
square root of its share among all features, so long and short texts weigh alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import sparse_ftrl
from clickloom.llm.words import FOLD, NOT_BLANK, combine, mix, run_hashes, word_bounds

# documents of this remainder are held out
FOLDS, HELD_OUT = 4, 2


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("0") : ord("9") + 1] = ord("9")
    table[128:] = ord("a")
    return table


_CLASS = _classes()
_REPEATED = mix(np.array([1], np.uint64))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all n-grams of words and shapes."""
    starts, ends, firsts = word_bounds(data, offsets, NOT_BLANK)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    words = run_hashes(FOLD[data], starts, ends)
    kind = _CLASS[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    place = np.concatenate([[0], np.cumsum(turn)])
    shapes = run_hashes(kind[turn], place[starts], place[ends])
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shapes = np.where(same, _REPEATED[0], shapes)
    out, where = [], []
    for stream, width, tag in ((words, 1, 1), (words, 2, 1), (shapes, 1, 2), (shapes, 2, 2), (shapes, 3, 2)):
        n = len(stream) - width + 1
        if n > 0:
            inside = text[:n] == text[width - 1 :]
            grams = combine(np.full(n, tag, np.uint64), *[stream[k : n + k] for k in range(width)])
            out.append(grams[inside])
            where.append(text[:n][inside])
    return np.concatenate(out), np.concatenate(where)


def damp(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.sqrt(count / total)


def held_out(key: str = "doc_id"):
    """Whether labels of this document must not be learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class QualityClassifier:
    """Learns ``labels.quality`` of the folds that are not held out, from at most ``sample.rows`` rows."""

    ftrl: sparse_ftrl.Ftrl = field(default_factory=lambda: sparse_ftrl.Ftrl(alpha=1.0, l1=0.3))
    sample: sparse_ftrl.Sample = sparse_ftrl.Sample(rows=6_000)
    threshold: float = 0.7

    def fit(self, docs: DataFrame, labels: DataFrame) -> sparse_ftrl.Weights:
        known = labels.where(~held_out())
        return sparse_ftrl.fit(docs, known, "quality", features, damp, self.ftrl, self.sample)

    def score(self, docs: DataFrame, model: sparse_ftrl.Weights, out: str = "score") -> DataFrame:
        """``docs`` with the probability of good quality added; null and empty texts get the intercept's."""
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

    def keep(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The documents that are not rejected, with their columns as they are.

        Where nothing could be learned (no labels of use, or no weight came out of them) none is rejected.
        """
        model = self.fit(docs, labels)
        if len(model.index) == 0:
            return docs
        out = sparse_ftrl.free_name(docs, "_quality")
        scored = self.score(docs, model, out)
        return scored.where(F.col(out) >= self.threshold).drop(out)
