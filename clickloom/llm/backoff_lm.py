"""Stupid-backoff language-model scores of all documents against n-gram counts of all documents.

Relationally: explode every document into n-grams, count them in tables partitioned by n-gram hash, join the
counts back to the exploded n-grams, and sum per document. A row per n-gram and document would be shuffled
several times, so documents are dealt to blocks by the hash of id and text and both relations travel packed: a
block sends each hash partition its distinct n-grams with their numbers, as sorted hashes in compressed
differences, and gets back their counts in the same order. A frequent n-gram is one entry per block, however
many documents have it. Blocks and hash partitions have a set size, so their numbers follow the input.

The score of a word after the ``order - 1`` words before it is count(n-gram) / count(its first n - 1 words)
for the longest n-gram with a count of at least ``min_count``, times ``discount`` for every longer one that
was tried; a word of no such n-gram scores max(count, 1) / words of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.tables import text_batches
from clickloom.llm.words import NOT_BLANK, buffers, combine, hash_words, pieces, tidy
from clickloom.session import write_table

_CODEC = "zstd"


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; sorted ones go in as differences."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec=_CODEC, asbytes=True) if len(values) else b""


def unpacked(raw: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, n * 8, codec=_CODEC, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def ngrams(words: np.ndarray, firsts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per n from 1 to ``order`` the hash of the n-gram that ends at every word; 0 where its text is too short."""
    start = np.repeat(firsts[:-1], np.diff(firsts))
    out = []
    for n in range(1, order + 1):
        grams = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            made = combine(*[words[k : len(words) - n + 1 + k] for k in range(n)])
            ends = np.arange(n - 1, len(words))
            made[made == 0] = 1
            grams[ends] = np.where(ends - start[ends] >= n - 1, made, 0)
        out.append(grams)
    return out


@dataclass(frozen=True)
class BackoffScorer:
    """``block_bytes`` and ``partition_bytes`` of text stand behind a block and a hash partition."""

    order: int = 3
    discount: float = 0.4
    min_count: int = 2
    block_bytes: int = 12 << 20
    partition_bytes: int = 24 << 20

    def score(self, docs: DataFrame) -> DataFrame:
        """One row per document: doc_id, n_words, log_score (sum of natural logarithms), mean_log_score.

        Words are runs of non-blank characters with A-Z in lower case. A null, empty or blank text has no
        words, the sum 0 and no mean. Null ids are scored too. Repeated rows count as often as they stand.
        Other columns are ignored.
        """
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        blocks = max(1, -(-size // self.block_bytes))
        parts = max(1, -(-size // self.partition_bytes))
        order, least, discount = self.order, self.min_count, self.discount

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = np.asarray(batch.column(2))
                where = np.argsort(block, kind="stable")
                cuts = np.flatnonzero(np.diff(block[where])) + 1
                rows = []
                for part in np.split(where, cuts):
                    if len(part):
                        some = batch.take(pa.array(part))
                        data, offsets = buffers(some.column(1))
                        ids = some.column(0)
                        held = np.asarray(ids.is_valid())
                        rows.append(
                            (
                                int(block[part[0]]),
                                np.asarray(ids.fill_null(0)).astype("<i8").tobytes(),
                                held.astype(np.uint8).tobytes(),
                                offsets.astype("<i8").tobytes(),
                                pa.compress(data.tobytes(), codec=_CODEC, asbytes=True) if len(data) else b"",
                            )
                        )
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["block", "ids", "held", "offsets", "texts"],
                )

        def ask(g: pd.DataFrame) -> pd.DataFrame:
            known, counts = distinct(_grams_of(g, order))
            rows = []
            part = (known >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            for p, (a, b) in enumerate(_ranges(part, parts)):
                if b > a:
                    rows.append((p, int(g["block"].iloc[0]), b - a, _sorted_packed(known[a:b]), packed(counts[a:b])))
            return pd.DataFrame(rows, columns=["part", "block", "n", "grams", "counts"])

        def answer(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("block")
            grams = [_sorted_unpacked(r, n) for r, n in zip(g["grams"], g["n"], strict=True)]
            every, which = np.unique(np.concatenate(grams), return_inverse=True)
            own = np.concatenate([unpacked(r, n) for r, n in zip(g["counts"], g["n"], strict=True)])
            total = np.zeros(len(every), np.uint64)
            np.add.at(total, which, own)
            total[total < least] = 0
            found = np.split(total[which], np.cumsum(g["n"].to_numpy())[:-1])
            return pd.DataFrame(
                {"block": g["block"].to_numpy(), "part": g["part"].to_numpy(), "n": g["n"].to_numpy(), "counts": [packed(f) for f in found]}
            )

        def finish(g: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            if len(g) == 0:
                return pd.DataFrame(columns=["doc_id", "n_words", "log_sum", "unigrams"])
            answers = answers.sort_values("part")
            counts = [unpacked(r, n) for r, n in zip(answers["counts"], answers["n"], strict=True)]
            count = np.concatenate(counts) if counts else np.zeros(0, np.uint64)
            grams = list(_grams_of(g, order))
            known, _ = distinct(iter(grams))
            out = []
            for ids, firsts, by_order in grams:
                found = [np.where(h > 0, count[np.searchsorted(known, h) % max(1, len(known))], 0).astype(np.float64) for h in by_order]
                present = [h > 0 for h in by_order]
                logs, unigram = _log_scores(found, present, discount)
                text = np.repeat(np.arange(len(ids)), np.diff(firsts))
                out.append(
                    pd.DataFrame(
                        {
                            "doc_id": ids,
                            "n_words": np.diff(firsts),
                            "log_sum": np.bincount(text, logs, minlength=len(ids)),
                            "unigrams": np.bincount(text, unigram, minlength=len(ids)).astype(np.int64),
                        }
                    )
                )
            return pd.concat(out)

        # by text as well: rows without an id, or of one id, are documents like others
        block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
        dealt = text_batches(texts).select("doc_id", "text", block).mapInArrow(
            tidy(pack), "block bigint, ids binary, held binary, offsets binary, texts binary"
        )
        by_block = dealt.groupBy("block")
        asked = by_block.applyInPandas(ask, "part bigint, block bigint, n bigint, grams binary, counts binary")
        answers = asked.groupBy("part").applyInPandas(answer, "block bigint, part bigint, n bigint, counts binary")
        scored = by_block.cogroup(answers.groupBy("block")).applyInPandas(
            finish, "doc_id bigint, n_words bigint, log_sum double, unigrams bigint"
        )
        scored = write_table(scored, "scores")
        words = scored.agg(F.greatest(F.sum("n_words"), F.lit(1))).first()[0] or 1
        log_score = F.col("log_sum") - F.col("unigrams") * float(np.log(words))
        return scored.select(
            "doc_id",
            "n_words",
            log_score.alias("log_score"),
            (log_score / F.nullif(F.col("n_words"), F.lit(0))).alias("mean_log_score"),
        )


def _grams_of(g: pd.DataFrame, order: int) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    """(ids, first word of each text and the end, n-grams by order) of the packed rows of a block."""
    for raw_ids, held, raw_offsets, texts in zip(g["ids"], g["held"], g["offsets"], g["texts"], strict=True):
        ids = np.frombuffer(raw_ids, "<i8").astype(object)
        ids[np.frombuffer(held, np.uint8) == 0] = None
        offsets = np.frombuffer(raw_offsets, "<i8")
        raw = pa.decompress(texts, int(offsets[-1]), codec=_CODEC, asbytes=True) if offsets[-1] else b""
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ids), [None, pa.py_buffer(raw_offsets), pa.py_buffer(raw)]
        )
        for a, b, data, bounds in pieces(column):
            words, firsts = hash_words(data, bounds, NOT_BLANK)
            yield ids[a:b].tolist(), firsts, ngrams(words, firsts, order)


def distinct(grams: Iterator[tuple[list, np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a block, all orders together, and how often each stands there."""
    every = [h for _, _, by_order in grams for h in by_order]
    if not every:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    known, counts = np.unique(np.concatenate(every), return_counts=True)
    real = known > 0
    return known[real], counts[real].astype(np.uint64)


def _ranges(part: np.ndarray, parts: int) -> list[tuple[int, int]]:
    cuts = np.searchsorted(part, np.arange(parts + 1))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _sorted_packed(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def _sorted_unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, n), dtype=np.uint64)


def _log_scores(found: list[np.ndarray], present: list[np.ndarray], discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Per word the logarithm of its score, without the corpus size where it scored as a unigram, and whether it did."""
    n = len(found[0])
    logs, done, tried = np.zeros(n), np.zeros(n, bool), np.zeros(n)
    for k in range(len(found) - 1, 0, -1):
        context = np.concatenate([[0.0], found[k - 1][:-1]])
        hit = present[k] & ~done & (found[k] > 0)
        logs[hit] = np.log(found[k][hit] / context[hit])
        done |= hit
        tried += present[k] & ~done
    logs[~done] = np.log(np.maximum(found[0][~done], 1))
    return logs + tried * np.log(discount), ~done
