"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding.

A text is a space and its UTF-8 bytes; a piece's leading marks are spaces. No piece crosses a place between
two bytes that stand together in none, so a text falls apart into short units, and equal units of a batch
share one lattice. Forward filtering sums, for every end position, the weights of all segmentations up to
it; backward sampling then draws the last piece, the one before it, and so on, for all occurrences of all
units at once. The random number of a step depends on the seed, the row's key and the position alone, so a
row is segmented the same way in any batch, task or run.

A piece of rank r has the weight (r + ``shift``) ** -``sharpness``: the vocabulary lists pieces by rank, not
by probability. Characters without a piece are bytes, and so is the mark itself where a text holds one, so
decoding gives back every text to the last byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.tables import text_batches
from clickloom.llm.words import mix, pieces, run_hashes, tidy

MARK = "▁"
# bytes of a unit that are summed without logarithms, and the usual logarithm of a weight per byte
SHORT, PER_BYTE = 48, 2.7


def default_model() -> str:
    """The vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Piece bytes, weights, a trie of reversed pieces, and the byte pairs that stand inside pieces."""

    def __init__(self, model_file: str, shift: float, sharpness: float, byte_weight: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.bytes: list[bytes] = []
        self.byte_id = np.full(256, -1, np.int32)
        usable, ranks = np.zeros(n, bool), np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                self.byte_id[int(piece[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())
                usable[i] = True
                ranks[i] = max(0.0, -sp.get_score(i)) if sp.get_score(i) > -1e8 else 0.0
        self.weight = np.where(usable, -sharpness * np.log(ranks + shift), byte_weight)
        self.longest = max(len(self.bytes[i]) for i in np.flatnonzero(usable))
        self.inside = np.zeros((256, 256), bool)
        following: dict[int, int] = {}
        ids = [-1]
        for i in np.flatnonzero(usable).tolist():
            b = self.bytes[i]
            for x, y in zip(b[:-1], b[1:], strict=True):
                self.inside[x, y] = True
            node = 0
            for x in reversed(b):
                key = node << 8 | x
                child = following.get(key)
                if child is None:
                    child = following[key] = len(ids)
                    ids.append(-1)
                node = child
            if ids[node] < 0:
                ids[node] = i
        self.ids = np.array(ids, np.int32)
        # only nodes with children have a row of steps; row 0 is that of the nodes without
        parents = sorted({key >> 8 for key in following})
        self.row = np.zeros(len(ids), np.int64)
        self.row[parents] = np.arange(1, len(parents) + 1)
        keys = np.fromiter(following.keys(), np.int64)
        self.step = np.full((len(parents) + 1) << 8, -1, np.int32)
        self.step[self.row[keys >> 8] << 8 | keys & 255] = np.fromiter(following.values(), np.int32)
        lengths = np.array([len(b) for b in self.bytes])
        # the last entry stands for no piece
        self.factor = np.append(np.exp(self.weight + PER_BYTE * lengths), 0.0).astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    # ---- encoding

    def edges(self, data: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """(position, length - 1): the piece that ends at a position, -1 for none.

        ``offset`` is each byte's place in its unit.
        """
        n = len(data)
        columns = []
        at, node = np.arange(n), np.zeros(n, np.int64)
        for length in range(self.longest):
            node = self.step[self.row[node] << 8 | data[at - length]]
            alive = node >= 0
            at, node = at[alive], node[alive].astype(np.int64)
            columns.append(np.full(n, -1, np.int32))
            columns[-1][at] = self.ids[node]
            more = offset[at] > length
            at, node = at[more], node[more]
            if len(at) == 0:
                break
        while len(columns) > 1 and columns[-1].max() < 0:
            columns.pop()  # as narrow as the batch allows
        out = np.stack(columns, axis=1)
        own = out[:, 0] >= 0
        for size, low, high in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
            if size <= len(columns):
                ends = np.flatnonzero(out[:, size - 1] >= 0)
                lead = data[ends - size + 1]
                for k in range(size):
                    own[ends[(lead >= low) & (lead <= high)] - k] = True
        out[~own, 0] = self.byte_id[data[~own]]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, first id of each text and the end)."""
        rows = len(offsets) - 1
        # a space in front of every text that is not empty
        filled = (np.diff(offsets) > 0).astype(np.int64)
        bounds = offsets + np.concatenate([[0], np.cumsum(filled)])
        raw = np.full(bounds[-1], 0x20, np.uint8)
        place = np.ones(bounds[-1], bool)
        place[bounds[:-1][filled > 0]] = False
        raw[place] = data
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        new = np.ones(n, bool)
        new[1:] = ~self.inside[raw[:-1], raw[1:]]
        new[bounds[:-1][filled > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        _, first, which = np.unique(run_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        sizes = ends[first] - starts[first]
        unit_start = np.concatenate([[0], np.cumsum(sizes)])
        total = int(unit_start[-1])
        offset = np.arange(total) - np.repeat(unit_start[:-1], sizes)
        unit = raw[np.repeat(starts[first], sizes) + offset]
        table = self.edges(unit, offset)
        drawn = self._forward(table, offset)
        # backward: all occurrences at once, from their ends
        out = np.full(n, -1, np.int32)
        text = np.repeat(np.arange(rows), np.diff(bounds))
        seeds = mix(keys.astype(np.int64).view(np.uint64))
        here, there = ends - 1, unit_start[which + 1] - 1
        origin = unit_start[which]
        while len(here):
            row = text[here]
            u = mix(seeds[row] + (here - bounds[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = (u >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            length = np.zeros(len(here), np.int64)
            open_ = np.flatnonzero(drawn[there, 0] <= u)
            while len(open_):
                length[open_] += 1
                open_ = open_[drawn[there[open_], length[open_]] <= u[open_]]
            out[here] = table[there, length]
            here, there = here - length - 1, there - length - 1
            more = there >= origin
            here, there, origin = here[more], there[more], origin[more]
        made = out >= 0
        count = np.concatenate([[0], np.cumsum(made)])
        return out[made], count[bounds]

    def _forward(self, table: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Cumulated probabilities of the length of the last piece before every position.

        Sums of products, with a constant factor per byte that all segmentations of a unit share, so they
        stay in range up to ``SHORT`` bytes; longer units are summed as logarithms.
        """
        n, width = table.shape
        drawn = np.full((n, width), 2.0, np.float32)
        alpha = np.zeros(n + width)
        windows = np.lib.stride_tricks.sliding_window_view(alpha, width)
        order = np.argsort(offset, kind="stable")
        cuts = np.searchsorted(offset[order], np.arange(int(offset.max()) + 2))
        shift = np.zeros(n + width)
        for t in range(len(cuts) - 1):
            at = order[cuts[t] : cuts[t + 1]]
            weight = self.factor[table[at]][:, ::-1]
            # column j of a window stands for length width - j
            if t < SHORT:
                part = windows[at] * weight
            else:
                back = at[:, None] + np.arange(width)[None, :]
                scale = np.where(alpha[back] > 0, shift[back], -np.inf)
                top = scale.max(axis=1)
                shift[at + width] = top
                part = alpha[back] * np.exp(scale - top[:, None]) * weight
            if t < width:
                part[:, width - 1 - t] = weight[:, width - 1 - t]  # the piece that starts the unit
            part = part[:, ::-1]
            sums = np.cumsum(part, axis=1)
            total = sums[:, -1]
            if t >= SHORT - 1:
                norm = np.where(total > 0, total, 1.0)
                alpha[at + width] = total / norm
                shift[at + width] += np.log(norm)
            else:
                alpha[at + width] = total
            share = np.where(sums < total[:, None], sums, np.inf)  # the last possible length takes what is left
            drawn[at] = share / np.maximum(total, 1e-300)[:, None]
        return drawn

    # ---- decoding

    def decode(self, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of the id sequences, without the space in front."""
        sizes = self.starts[ids + 1] - self.starts[ids]
        to = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.starts[ids] - to[:-1], sizes) + np.arange(to[-1])
        raw, bounds = self.flat[source], to[firsts]
        keep = np.ones(len(raw), bool)
        filled = np.diff(bounds) > 0
        keep[bounds[:-1][filled]] = False
        return raw[keep], bounds - np.concatenate([[0], np.cumsum(filled)])


_loaded: dict[tuple, Vocabulary] = {}


@dataclass(frozen=True)
class PieceSampler:
    """Samples segmentations with the vocabulary of ``model_file``; the same ``seed`` gives the same ones."""

    model_file: str | None = None
    seed: int = 7
    shift: float = 10.0
    sharpness: float = 1.0
    byte_weight: float = -12.0

    def vocabulary(self) -> Vocabulary:
        """Loaded once per Python process."""
        key = (self.model_file or default_model(), self.shift, self.sharpness, self.byte_weight)
        if key not in _loaded:
            _loaded[key] = Vocabulary(*key)
        return _loaded[key]

    def encode(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """One row per document: key, ids, n_tokens, ids_crc32, text_crc32, lossless.

        A null or empty text has no ids. A null key is the key 0. Rows with the same key and text get the
        same ids. ``ids_crc32`` is taken over little-endian 32-bit ids, ``text_crc32`` over the decoded
        bytes, and ``lossless`` says whether these are the text's. Other columns are ignored.
        """
        seed = np.uint64(self.seed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = self.vocabulary()
            for batch in batches:
                keys = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
                for first, end, data, offsets in pieces(batch.column(1), 1 << 19):
                    own = mix(keys[first:end].view(np.uint64) + seed).view(np.int64)
                    ids, firsts = vocabulary.encode(data, offsets, own)
                    text, bounds = vocabulary.decode(ids, firsts)
                    ids = np.ascontiguousarray(ids, "<i4")
                    cut = range(end - first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, end - first),
                            pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(ids)),
                            pa.array(np.diff(firsts)),
                            pa.array([zlib.crc32(ids[firsts[k] : firsts[k + 1]]) for k in cut], pa.int64()),
                            pa.array([zlib.crc32(text[bounds[k] : bounds[k + 1]]) for k in cut], pa.int64()),
                            pa.array(
                                [
                                    np.array_equal(text[bounds[k] : bounds[k + 1]], data[offsets[k] : offsets[k + 1]])
                                    for k in cut
                                ]
                            ),
                        ],
                        [key, "ids", "n_tokens", "ids_crc32", "text_crc32", "lossless"],
                    )

        texts = docs.select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").alias("text"))
        return text_batches(texts).mapInArrow(
            tidy(run),
            f"`{key}` bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, text_crc32 bigint, lossless boolean",
        )

    def decode(self, encoded: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, text) from (key, ids); missing ids give a missing text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = self.vocabulary()
            for batch in batches:
                out = []
                for ids in batch.column(1):
                    if not ids.is_valid:
                        out.append(None)
                        continue
                    values = np.asarray(ids.values, np.int64)
                    out.append(vocabulary.decode(values, np.array([0, len(values)]))[0].tobytes().decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

        return encoded.select(key, "ids").mapInArrow(run, f"`{key}` bigint, text string")
