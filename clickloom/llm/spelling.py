"""Spelling variants: words one edit apart, found by Gram matrices of letter counts in adjacent length blocks.

An edit leaves one half of a word as it was, so every word stands in the blocks of its first and of its last
half, once as the shorter and once as the longer of a pair. Inside a block, which holds words of two adjacent
lengths, the products of letter-count vectors give all squared distances at once: one edit changes them by two
at most. Pairs within that are compared letter by letter. Nothing but near pairs leaves a block, and of these
only sums and best ones per word. Blocks above ``tile`` words are cut into tiles, and every two tiles meet in a
group of their own, so no group grows with the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.tables import bounded_broadcast, keyed_texts
from clickloom.llm.words import tidy
from clickloom.session import write_table

# distinct words that a task holds before it hands their counts on
_HELD = 200_000

# rows of blocks that one Python group takes
_GROUP_ROWS = 20_000

# products of letter counts that are looked at together
_PRODUCTS = 1 << 21

_SMALL = {c: c + 32 for c in range(65, 91)}


def word_counts(least: int, every: int):
    """Function from batches (doc_id, text) to counts (word, n), summed per task as far as memory allows.

    A word is a run of letters with A-Z in lower case. Where ``every`` divides the checksum of the row's id
    and the word, one of its letters is left out, as a copyist would.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in Counter(runs.findall(text)).items():
                    word = run.lower() if run.isascii() else run.translate(_SMALL)
                    h = zlib.crc32(word.encode(), begun)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
            if len(held) >= _HELD:
                yield rows(held)
                held = Counter()
        yield rows(held)

    return tidy(count)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts in 64 classes; letters that share a class only bring words closer together."""
    n = len(codes)
    cells = (codes & 63) + (np.arange(n, dtype=np.uint32) << 6)[:, None]
    # sums of squares have to stay exact
    exact = np.float32 if codes.shape[1] < 2_000 else np.float64
    return np.bincount(cells.ravel(), minlength=n << 6).reshape(n, 64).astype(exact)


def _stacked(counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Count vectors of several blocks as (block, place, class), and squared norms, infinite at empty places."""
    places = np.arange(width)
    held = places < sizes[:, None]
    vectors = counts[np.where(held, starts[:, None] + places, 0)]
    return vectors, np.where(held, (vectors * vectors).sum(2), np.inf)


def _close(
    a: np.ndarray, a_from: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_size: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (in a, in b) of count vectors of the same block at a squared distance of at most two.

    Rows of ``a`` and ``b`` are in order of their blocks. Blocks of like size are multiplied in one stack, and a
    stack holds a bounded number of products.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    used = np.flatnonzero((a_size > 0) & (b_size > 0))
    widths = [1 << np.ceil(np.log2(x[used])).astype(np.int64) for x in (a_size, b_size)]
    order = np.lexsort(widths)
    used, widths = used[order], [w[order] for w in widths]
    edges = np.flatnonzero(np.diff(widths[0]) | np.diff(widths[1])) + 1
    for start, end in zip([0, *edges], [*edges, len(used)], strict=True):
        if start == end:
            continue
        wa, wb = int(widths[0][start]), int(widths[1][start])
        step = max(1, min(_PRODUCTS // (wa * wb), _PRODUCTS // (64 * max(wa, wb))))
        for k in range(start, end, step):
            own = used[k : min(k + step, end)]
            va, na = _stacked(a, a_from[own], a_size[own], wa)
            vb, nb = _stacked(b, b_from[own], b_size[own], wb)
            gram = va @ vb.transpose(0, 2, 1)
            block, i, j = np.nonzero(na[:, :, None] + nb[:, None, :] - 2.0 * gram <= 2.5)
            left.append(a_from[own][block] + i)
            right.append(b_from[own][block] + j)
    return np.concatenate(left), np.concatenate(right)


def _one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Of row pairs of codes, where leaving out one letter of the longer word gives the shorter one."""
    same = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return same + tail >= short.shape[1]


def near_in_blocks(
    shorter: list[str], short_block: np.ndarray, longer: list[str], long_block: np.ndarray, blocks: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words of one block that are one edit apart, as indices into shorter + longer.

    The blocks hold words of one length and of the next one, in order of the blocks' numbers; two of the longer
    ones are not paired.
    """
    n, length = len(shorter), len(shorter[0])
    codes = _codes(shorter, length)
    counts = _letter_counts(codes)
    numbers = np.arange(blocks)
    starts = np.searchsorted(short_block, numbers)
    sizes = np.searchsorted(short_block, numbers, "right") - starts
    i, j = _close(counts, starts, sizes, counts, starts, sizes)
    kept = i < j
    i, j = i[kept], j[kept]
    kept = (codes[i] != codes[j]).sum(1) == 1
    found = [(i[kept], j[kept])]
    if longer:
        more = _codes(longer, length + 1)
        long_starts = np.searchsorted(long_block, numbers)
        long_sizes = np.searchsorted(long_block, numbers, "right") - long_starts
        i, j = _close(counts, starts, sizes, _letter_counts(more), long_starts, long_sizes)
        kept = _one_inserted(codes[i], more[j])
        found.append((i[kept], j[kept] + n))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


_NEAR = "word string, n_near bigint, near_n bigint, near string"


def _near_words(group: pa.Table) -> pa.Table:
    """Per word and block: how many near words the block holds, and the most frequent of these.

    A pair of unequal length that shares its first half and its last one is left to the block of the first.
    """
    key = ("first_half", "half", "low", "high")
    group = group.sort_by([(c, "ascending") for c in ("least", "longer", *key)])
    words, ns = group.column("word").to_pylist(), group.column("n").to_numpy()
    least, tile, low, high = (group.column(c).to_numpy() for c in ("least", "tile", "low", "high"))
    first, longer = (np.array(group.column(c).to_pylist(), dtype=bool) for c in ("first_half", "longer"))
    numbers: dict[tuple, int] = {}
    named = zip(least.tolist(), *[group.column(c).to_pylist() for c in key], strict=True)
    # rows of one length come in order of their blocks, so numbers given to the shorter words are in order
    block = np.array([numbers.setdefault(x, len(numbers)) for x in named], dtype=np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(least):
        start, end = np.searchsorted(least, [length, length + 1])
        split = start + int(np.count_nonzero(~longer[start:end]))
        if split == start:
            continue
        base = int(block[start])
        # blocks without a shorter word have no pairs here
        rest = split + np.flatnonzero(block[split:end] <= block[split - 1])
        i, j = near_in_blocks(
            words[start:split], block[start:split] - base, [words[k] for k in rest], block[rest] - base,
            int(block[split - 1]) - base + 1,
        )
        rows = np.concatenate([np.arange(start, split), rest])
        left.append(rows[i])
        right.append(rows[j])
    i, j = np.concatenate(left), np.concatenate(right)
    kept = (low[i] == high[i]) | (tile[i] != tile[j])
    kept &= first[i] | ~longer[j] | np.fromiter(
        (words[a][: n // 2] != words[b][: n // 2] for a, b, n in zip(i.tolist(), j.tolist(), least[i].tolist(), strict=True)), bool, len(i)
    )
    x, y = np.concatenate([i[kept], j[kept]]), np.concatenate([j[kept], i[kept]])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[y], -ns[y], x))
    x, y = x[order], y[order]
    heads = np.flatnonzero(np.diff(x, prepend=-1))
    return pa.table(
        {
            "word": pa.array([words[k] for k in x[heads]], pa.string()),
            "n_near": pa.array(np.diff(heads, append=len(x)), pa.int64()),
            "near_n": pa.array(ns[y[heads]], pa.int64()),
            "near": pa.array([words[k] for k in y[heads]], pa.string()),
        }
    )


@dataclass(frozen=True)
class SpellingVariants:
    """Words of at least ``least_length`` letters and ``least_count`` occurrences, with their usual spelling.

    A word's form is its near word of largest count (ties: the smallest), if that is at least ``ratio`` times
    its own; the root follows forms to the last. ``every`` sets how often a letter is left out of an
    occurrence; ``tile`` is the size above which blocks are cut.
    """

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    every: int = 31
    tile: int = 2_048

    def group(self, docs: DataFrame) -> DataFrame:
        """(word, form, root, n, n_near, form_n) of every word of the texts.

        Missing and empty texts have no words, a missing doc_id counts as an empty one, repeated rows count
        each, and other columns are not looked at. No documents give no rows.
        """
        counted = (
            keyed_texts(docs)
            .mapInArrow(word_counts(self.least_length, self.every), "word string, n bigint")
            .groupBy("word")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= self.least_count)
        )
        words = write_table(counted, "words")
        near = self.near(words)
        usual = F.col("near_n") >= self.ratio * F.col("n")
        formed = write_table(
            words.join(near, "word", "left").select(
                "word",
                "n",
                F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                F.when(usual, F.col("near")).alias("form"),
                F.when(usual, F.col("near_n")).alias("form_n"),
            ),
            "forms",
        )
        roots = self._roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
        return formed.join(roots, "word", "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
        )

    def near(self, words: DataFrame) -> DataFrame:
        """(word, n_near, near_n, near) of the written ``words`` (word, n) that have near words."""
        blocks = self._blocks(words)
        key = ["first_half", "least", "half"]
        large = write_table(
            blocks.groupBy(*key).count().where(F.col("count") > self.tile).select(
                *key, F.ceil(F.col("count") / self.tile).cast("int").alias("tiles")
            ),
            "large-blocks",
        )
        tiled = blocks.join(bounded_broadcast(large, large.count()), key, "left")
        placed = (
            tiled.withColumn("tile", F.expr("int(pmod(xxhash64(word), coalesce(tiles, 1)))"))
            .withColumn("other", F.explode(F.expr("sequence(0, coalesce(tiles, 1) - 1)")))
            .select(*key, "longer", "word", "n", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
        )
        groups = max(1, -(-4 * words.count() // _GROUP_ROWS))
        hashed = F.pmod(F.xxhash64(*key, "low", "high"), F.lit(groups)).alias("dealt")
        found = placed.select("*", hashed).groupBy("dealt").applyInArrow(_near_words, _NEAR)
        best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
        return (
            found.groupBy("word")
            .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))
        )

    def _blocks(self, words: DataFrame) -> DataFrame:
        """Every word in the blocks of its first and its last half, as the shorter and the longer of a pair."""

        def halves(least: str, longer: str) -> list[str]:
            kept = f"int({least} div 2)"
            return [
                f"named_struct('first_half', true, 'least', {least}, 'half', left(word, {kept}), 'longer', {longer})",
                f"named_struct('first_half', false, 'least', {least}, 'half', right(word, {least} - {kept}), 'longer', {longer})",
            ]

        places = ", ".join(halves("length(word)", "false") + halves("(length(word) - 1)", "true"))
        return (
            words.select("word", "n", F.expr(f"inline(array({places}))"))
            .where(F.col("least") >= self.least_length)
        )

    @staticmethod
    def _roots(links: DataFrame) -> DataFrame:
        """Follow (word, root) to the end, twice as far every round; counts grow tenfold at each link."""
        links = write_table(links, "roots")
        while True:
            onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
            stepped = write_table(links.join(onward, "root", "left").select("word", "root", "next"), "roots")
            if stepped.where("next IS NOT NULL").isEmpty():
                return links
            links = stepped.select("word", F.coalesce("next", "root").alias("root"))
