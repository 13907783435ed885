"""Token-id files: Parquet list columns in document order, written and read back by Spark.

Documents are range-partitioned and sorted by id, tokenized in that order, and written with one row per
document: id, number of tokens, first token within the file part, and the ids as a list. Ids are dictionary
encoded (16 bits a token for a 50k vocabulary) or, with ``encoding="delta"``, delta encoded by the second
version of the format. Row groups and pages have a set size, and pages carry the format's column index, so
a reader that wants some documents, or their metadata alone, reads the pages and columns it needs.

Tokenizing keeps the ids of runs of letters, digits or signs that have been met before; whatever is not
certainly cut into such runs goes to the tokenizer as it is.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.tables import bounded_broadcast, text_batches
from clickloom.llm.words import byte_set, pieces, run_hashes, tidy
from clickloom.session import new_path

# runs whose ids a Python worker keeps, in some 60 MB; a full store is emptied, which costs time alone
KEPT_RUNS = 1_000_000
# new runs that go to the tokenizer as one text
JOINED_RUNS = 4_000


def default_tokenizer() -> str:
    """The vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """Blank 0, letter 1, digit 2, other sign 3, line end 4."""
    table = np.full(256, 3, np.uint8)
    for low, high in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = 1
    table[0x30:0x3A] = 2
    table[0x20], table[0x0A] = 0, 4
    return table


_CLASS = _classes()
# bytes that leave the split to the tokenizer: other blanks, apostrophes, and all but Latin letters
_ODD = byte_set((0x00, 0x09), (0x0B, 0x1F), (0x27, 0x27), (0x7F, 0x7F), (0xC0, 0xC2), (0xCA, 0xFF))


class RunEncoder:
    """Ids of texts as 32-bit integers, equal to the tokenizer's own, with the ids of known runs kept.

    The vocabulary's pattern cuts a text into runs of letters, digits or other signs, each with the blank
    before it. In texts of Latin letters, single blanks and line ends, and no apostrophes, the runs can be
    told from their bytes; equal runs have equal ids. Any other text goes to the tokenizer as a whole.
    """

    def __init__(self, tokenizer_file: str) -> None:
        # tasks are what runs side by side; threads of a worker would each hold buffers of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        # a token's characters stand for one byte each
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)
        self.flat, self.used, self.entries = np.zeros(1 << 16, np.int32), 0, 0
        self.starts = np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        rows = len(offsets) - 1
        odd = self._odd(data, offsets)
        kind = _CLASS[data]
        before = np.empty(len(data), np.uint8)
        before[1:] = kind[:-1]
        begin = offsets[:-1][np.diff(offsets) > 0]
        new = (kind != before) | (kind == 4)
        new &= before != 0
        new[begin] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        text = np.searchsorted(offsets, starts, "right") - 1
        fine = ~odd[text]
        starts, ends, text = starts[fine], ends[fine], text[fine]
        entries = self._entries(run_hashes(data, starts, ends), data, starts, ends)
        sizes = self.starts[entries + 1] - self.starts[entries]
        counts = np.bincount(text, sizes, minlength=rows).astype(np.int64)
        others = {int(k): self.whole(data[offsets[k] : offsets[k + 1]].tobytes().decode()) for k in np.flatnonzero(odd)}
        for k, ids in others.items():
            counts[k] = len(ids)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        total = int(sizes.sum())
        to = np.cumsum(sizes) - sizes
        found = self.flat[np.repeat(self.starts[entries] - to, sizes) + np.arange(total)]
        if not others:
            return found, bounds
        out = np.empty(bounds[-1], np.int32)
        own = np.ones(len(out), bool)
        for k, ids in others.items():
            own[bounds[k] : bounds[k + 1]] = False
            out[bounds[k] : bounds[k + 1]] = ids
        out[own] = found
        return out, bounds

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that the tokenizer has to split itself."""
        blank = (data == 0x20) | (data == 0x0A)
        strange = _ODD[data]
        strange[:-1] |= blank[:-1] & blank[1:]
        strange[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        last = offsets[1:][np.diff(offsets) > 0] - 1
        strange[last] |= data[last] == 0x20
        at = [np.flatnonzero(strange)]
        raw = data.tobytes()
        for s in self.special:
            k = raw.find(s)
            while k >= 0:
                at.append(np.array([k]))
                k = raw.find(s, k + 1)
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, np.concatenate(at), "right") - 1] = True
        return odd

    def _entries(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = self._find(hashes)
        if not (found < 0).any():
            return found
        unknown = np.flatnonzero(found < 0)
        new, first = np.unique(hashes[unknown], return_index=True)
        if self.entries and self.entries + len(new) > KEPT_RUNS:
            self._clear()
            return self._entries(hashes, data, starts, ends)
        fresh = unknown[first]
        led = data[starts[fresh]] == 0x20
        fresh, n = np.concatenate([fresh[led], fresh[~led]]), int(led.sum())
        kept = np.arange(self.entries, self.entries + len(fresh), dtype=np.int32)
        for at in range(0, n, JOINED_RUNS):
            part = fresh[at : min(n, at + JOINED_RUNS)]
            self._add(*self._joined(data, starts[part], ends[part]))
        if n < len(fresh):
            self._add(*self._single(data, starts[fresh[n:]], ends[fresh[n:]]))
        self._keep(hashes[fresh], kept)
        found[unknown] = self._find(hashes[unknown])
        return found

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none; a slot that another hash has leads to the next."""
        at = hashes & np.uint64(len(self.slots) - 1)
        found = self.slots[at]
        rest = np.flatnonzero((found >= 0) & (self.keys[at] != hashes))
        while len(rest):
            at[rest] = (at[rest] + np.uint64(1)) & np.uint64(len(self.slots) - 1)
            found[rest] = self.slots[at[rest]]
            rest = rest[(found[rest] >= 0) & (self.keys[at[rest]] != hashes[rest])]
        return found

    def _keep(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Take in distinct new hashes; at least half of the slots stay free."""
        if 2 * self.entries > len(self.slots):
            used = self.slots >= 0
            hashes, entries = np.concatenate([self.keys[used], hashes]), np.concatenate([self.slots[used], entries])
            size = 1 << (2 * self.entries).bit_length()
            self.keys, self.slots = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        at = hashes & np.uint64(len(self.slots) - 1)
        while len(hashes):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            # of several for one slot, the last has it
            done = self.slots[at] == entries
            self.keys[at[done]] = hashes[done]
            hashes, entries, at = hashes[~done], entries[~done], at[~done]
            at = (at + np.uint64(1)) & np.uint64(len(self.slots) - 1)

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each run and the end) of runs led by blanks, which stay apart in one text.

        Tokens stand for bytes, so the bytes behind the ids tell where a run ends.
        """
        sizes = ends - starts
        last = np.cumsum(sizes)
        text = data[np.repeat(starts - (last - sizes), sizes) + np.arange(last[-1])].tobytes().decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        behind = np.concatenate([[0], np.cumsum(self.token_bytes[ids])])
        bounds = np.searchsorted(behind, np.concatenate([[0], last]))
        if behind[-1] != last[-1] or (behind[bounds[1:]] != last).any():
            return self._single(data, starts, ends)
        return ids, bounds

    def _single(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        made = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))])
        return np.fromiter(chain.from_iterable(made), np.int32, int(bounds[-1])), bounds

    def _add(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        n = self.entries
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(bounds) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(bounds)] = self.used + bounds
        self.used += len(ids)
        self.entries += len(bounds) - 1


_encoders: dict[str, RunEncoder] = {}


def encoder(tokenizer_file: str) -> RunEncoder:
    """Loaded once per Python process."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = RunEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


@dataclass(frozen=True)
class TokenFiles:
    """Writer and reader; ``end_id`` follows the ids of every document."""

    tokenizer_file: str | None = None
    end_id: int = 2
    encoding: str = "dictionary"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1_000

    def write(self, docs: DataFrame, path: str) -> None:
        """Write (part, doc_id, n_tokens, part_start, ids) in ascending order of doc_id.

        A null or empty text has the end id alone. Null ids come first; rows with the same id stay
        together, in an order that their texts decide. Other columns are ignored.
        """
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError("encoding is 'dictionary' or 'delta'")
        file, end = self.tokenizer_file or default_tokenizer(), self.end_id

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, total, own = TaskContext.get().partitionId(), 0, encoder(file)
            for batch in batches:
                for a, b, data, offsets in pieces(batch.column(1)):
                    ids, bounds = own.encode(data, offsets)
                    n = np.diff(bounds)
                    ids = np.insert(ids, bounds[1:], end)
                    bounds = bounds + np.arange(len(bounds))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(n), part, np.int32)),
                            batch.column(0).slice(a, b - a),
                            pa.array(n + 1),
                            pa.array(total + bounds[:-1]),
                            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                        ],
                        ["part", "doc_id", "n_tokens", "part_start", "ids"],
                    )
                    total += int(bounds[-1])

        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        tie = F.xxhash64("text")
        ordered = texts.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
        rows = text_batches(ordered).mapInArrow(
            tidy(run), "part int, doc_id bigint, n_tokens bigint, part_start bigint, ids array<int>"
        )
        delta = self.encoding == "delta"
        (
            rows.write.option("compression", "zstd")
            .option("parquet.block.size", self.row_group_bytes)
            .option("parquet.page.size", self.page_bytes)
            .option("parquet.page.row.count.limit", self.page_rows)
            .option("parquet.enable.dictionary", str(not delta).lower())
            .option("parquet.writer.version", "v2" if delta else "v1")
            .parquet(path)
        )

    def metadata(self, spark: SparkSession, path: str) -> DataFrame:
        """(doc_id, start, n_tokens) of every document, without reading any ids."""
        rows = spark.read.parquet(path).select("part", "doc_id", "n_tokens", "part_start")
        return self._placed(spark, path, rows).select("doc_id", "start", "n_tokens")

    def tokens(self, spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
        """(doc_id, ids), for the documents from ``first`` to ``last`` alone if given."""
        rows = spark.read.parquet(path).select("doc_id", "ids")
        if first is not None:
            rows = rows.where(F.col("doc_id") >= first)
        return rows.where(F.col("doc_id") <= last) if last is not None else rows

    def digests(self, spark: SparkSession, path: str) -> DataFrame:
        """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(3)
                raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
                ends = np.asarray(ids.offsets).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"],
                )

        rows = spark.read.parquet(path).select("part", "doc_id", "part_start", "ids")
        read = rows.mapInArrow(
            run, "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids_crc32 bigint"
        )
        return self._placed(spark, path, read).select("doc_id", "start", "n_tokens", "ids_crc32")

    def _placed(self, spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
        """Add what stands in earlier file parts to the starts: one total for each part."""
        totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("carried"))
        parts = totals.count()
        return rows.join(bounded_broadcast(carried, parts), "part").withColumn(
            "start", F.col("part_start") + F.col("carried")
        )

    def round_trip(self, docs: DataFrame) -> DataFrame:
        """Write to the shared folder and report from the files."""
        path = new_path(docs.sparkSession, "tokens")
        self.write(docs, path)
        return self.digests(docs.sparkSession, path)
