"""Words of whole texts as 64-bit hashes, computed on Arrow's byte buffers without Python strings.

A batch is cut into runs of whole texts of about ``PIECE`` bytes, so temporary arrays stay bounded by that
size or by one text, whichever is larger. A word's hash depends on its bytes alone: equal words have equal
hashes everywhere, and different ones collide with a chance of about 2^-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving freed memory back to the system at the end of a task.

    Spark keeps Python workers for later stages, and what their allocators hold counts until then.
    """

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fold_table() -> np.ndarray:
    """Byte to byte: A-Z become a-z, all else stays."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of the bytes in the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


FOLD = fold_table()
SAME = np.arange(256, dtype=np.uint8)
# words end at the six ASCII blanks
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
# digits, small letters and everything outside ASCII, for folded text
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a missing text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    n = len(texts)
    _, ends, data = texts.buffers()
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about ``limit`` bytes each."""
    data, offsets = buffers(texts)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << (n - 1).bit_length(), 2 * PIECE)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
        if size > 8 * PIECE:  # made for one very long text: do not keep it
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end) of the runs of ``inside`` bytes; no run crosses texts."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    marks = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = marks[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(marks & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = marks[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(marks & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over random byte values, mixed with the length."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def hash_words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray = FOLD
) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end)."""
    folded = fold[data]
    starts, ends, firsts = word_bounds(folded, offsets, inside)
    return run_hashes(folded, starts, ends), firsts


def combine(*parts: np.ndarray) -> np.ndarray:
    """Hash of a tuple of hashes; the order counts."""
    out = np.full(len(parts[0]), len(parts), np.uint64) * _BASE
    for part in parts:
        out = mix(out * _BASE + part)
    return out


def shingle_sets(words: np.ndarray, firsts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct ``width``-word shingles; fewer words make one shingle, no words none."""
    rolled = combine(*[words[k : len(words) - width + 1 + k] for k in range(width)]) if len(words) >= width else None
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield combine(*[words[i : i + 1] for i in range(a, b)])
        else:
            yield np.zeros(0, np.uint64)
