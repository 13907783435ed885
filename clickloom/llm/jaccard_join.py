"""Exact Jaccard join of documents over word shingles: pivots, Voronoi cells, triangle-inequality windows.

Equal shingle sets form a class, and the member with the smallest id stands for it. Pivots are documents:
the first one on each list of documents that share a prefix shingle, rare shingles first. A document's
cell is that of each pivot whose list it is on. Two linked documents always share a prefix shingle, hence
they share a cell. (At distances near 1, where nearly all documents are from each other, windows of the
triangle inequality alone would put every document in every cell; the prefix decides first.)

Most shingles stand in one document alone. The sketch that orders them also bounds how many documents have
each: lists that it bounds are brought together in one shuffle, and the others are joined to what was found
to be shared.

Cells of up to ``leaf_docs`` documents are joined in memory, in two steps. Bucket counts of the sets come
first: their L1 distance never exceeds the symmetric difference, so a document without a neighbour within
that bound and the size bound has no link in the cell, and its set stays where it is. In a larger cell every document measures its
distance to several pivots of the cell, and what is within the radius of a pivot is linked to it. The
documents that no pivot of the main group has caught are dealt to Voronoi regions by their nearest pivot
and cut by distance; a document takes part in a region when its distances to all pivots lie within the
region's range widened by the radius. Pairs inside the main group are linked already and never compared.
Regions are cut into groups of bounded size, so no task holds a large cell. The links found, fewer than
documents per group, go to connected components.

Nothing is capped: lists, cells and candidates may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.components import components
from clickloom.llm.tables import bounded_broadcast, keyed_texts, text_batches, written_broadcast
from clickloom.llm.words import NOT_BLANK, hash_words, mix, pieces, shingle_sets, tidy
from clickloom.session import shuffle_partitions, write_table

# counters of the sketch of document frequencies: a power of two, one byte each when broadcast
SKETCH_BLOCK = 1 << 15
MAX_SKETCH = 1 << 24
# counters for each document, while there are fewer than MAX_SKETCH
SKETCH_SHARE = 64
# a shingle on a counter of a lower level is rare: fewer than 2^RARE_LEVEL documents have it
RARE_LEVEL = 11
# least number of buckets of a signature, which counts the shingles of the set that fall on each
SIGNATURE = 64
# tasks whose counts are added in one group
ADDED_AT_ONCE = 256
# bytes of sets that one batch hands on
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class JaccardJoin:
    """Documents link when ``100 * intersection >= percent * union`` of their ``width``-word shingle sets.

    ``leaf_docs`` bounds the documents that are compared in one group, ``pivots`` is the number of pivots
    in a larger cell.
    """

    width: int = 5
    percent: int = 80
    leaf_docs: int = 192
    pivots: int = 12

    def classes(self, docs: DataFrame) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

        Null, empty or blank texts have no shingles and are their own component. Rows with the same doc_id
        are one document with several texts. Rows without doc_id keep their count, get no component and
        link nothing. An empty table gives no rows. Other columns are ignored.
        """
        signed = write_table(self._signed(docs), "signed")
        full = signed.where("n > 0 AND doc_id IS NOT NULL")
        classes = write_table(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")
        members = write_table(
            full.select("doc_id", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select("doc_id", "rep"), "members"
        )
        found = components(self.links(docs, signed, classes, members))
        named = (
            members.join(found, members["rep"] == found["node"], "left")
            .select("doc_id", F.coalesce("component", "rep").alias("_component"))
        )
        named = write_table(named, "named").groupBy("doc_id").agg(F.min("_component").alias("_component"))
        sizes = signed.select("doc_id", F.col("n").alias("n_shingles"))
        return sizes.join(named, "doc_id", "left").select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"),
        )

    def links(self, docs: DataFrame, signed: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
        """(a, b): verified links between class representatives that connect all linked ones."""
        full = signed.where("n > 0 AND doc_id IS NOT NULL")
        # lists of rare shingles are bounded, so one shuffle brings each together; most hold one document
        together = Window.partitionBy("shingle")
        rare = (
            full.select("doc_id", F.explode("rare").alias("shingle"))
            .select("doc_id", F.min("doc_id").over(together).alias("pivot"), F.max("doc_id").over(together).alias("last"))
            .where("pivot <> last")
            .select("pivot", "doc_id")
        )
        # the others may be of any size: they are never brought together
        postings = full.select("doc_id", "fp1", "fp2", F.explode("common").alias("shingle"))
        lists = (
            postings.groupBy("shingle")
            .agg(
                F.min("doc_id").alias("pivot"),
                *[f(c).alias(f"{f.__name__}_{c}") for c in ("fp1", "fp2") for f in (F.min, F.max)],
            )
            .where("min_fp1 <> max_fp1 OR min_fp2 <> max_fp2")
            .select("shingle", "pivot")
        )
        lists = write_table(lists, "lists")
        reps = classes.select(F.col("rep").alias("doc_id"))
        cells = (
            postings.join(lists, "shingle")
            .select("pivot", "doc_id")
            .union(rare)
            .distinct()
            .join(reps, "doc_id", "left_semi")
        )
        cells = write_table(cells, "cells")
        sizes = cells.groupBy("pivot").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
        sizes = write_table(sizes, "sizes")
        percent = self.percent
        sized = cells.join(sizes, "pivot")
        signatures = signed.where("n > 0").select("doc_id", "n", "signature")
        close = (
            sized.where(F.col("docs") <= self.leaf_docs)
            .select("pivot", "doc_id")
            .join(signatures, "doc_id")
            # many tasks although the rows are short: pairs of a cell take the time
            .repartition(shuffle_partitions(docs.sparkSession), "pivot")
            .groupBy("pivot")
            .applyInPandas(lambda g: _possible(g, percent), "pivot bigint, doc_id bigint")
        )
        close = write_table(close, "close")
        whole = sized.where(F.col("docs") > self.leaf_docs).select(F.lit(None).cast("bigint").alias("small"), F.col("pivot").alias("large"), "doc_id")
        placed = (
            close.select(F.col("pivot").alias("small"), F.lit(None).cast("bigint").alias("large"), "doc_id")
            .union(whole)
            .groupBy("doc_id")
            # a document has no more cells than prefix shingles
            .agg(F.collect_set("small").alias("small"), F.collect_set("large").alias("large"))
        )
        texts = keyed_texts(docs).join(written_broadcast(placed, "placed"), "doc_id")
        leaves = (
            self._sets(texts, "small")
            .groupBy("cell")
            .applyInPandas(lambda g: _leaf_links(g, percent), "a bigint, b bigint")
        )
        found = write_table(leaves, "links")
        large = sizes.where(F.col("docs") > self.leaf_docs)
        if not large.isEmpty():
            found = found.union(self._large_cells(write_table(self._sets(texts, "large"), "large")))
        # rows that share a doc_id are one document
        several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
        same = members.join(several, "doc_id").select("a", F.col("rep").alias("b"))
        return found.union(same)

    # ---- texts to sets

    def _signed(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n, fp1, fp2, rare, common, signature): set size, fingerprint, prefix in two parts, bucket counts."""
        spark = docs.sparkSession
        rows = docs.count()
        bits = min(MAX_SKETCH, max(SKETCH_BLOCK, 1 << (max(rows, 1) * SKETCH_SHARE - 1).bit_length()))
        width, percent = self.width, self.percent
        levels = spark.sparkContext.broadcast(_levels(docs, width, bits))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rank = np.frombuffer(levels.value, np.uint8)
            slot = np.uint64(len(rank) - 1)
            for batch in batches:
                for first, end, data, offsets in pieces(batch.column(1)):
                    n, fp1, fp2, rare, common, counts = [], [], [], [], [], []
                    for s in shingle_sets(*hash_words(data, offsets, NOT_BLANK), width):
                        n.append(len(s))
                        fp1.append(np.sum(mix(s)))
                        fp2.append(np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0))
                        keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                        level = rank[(s & slot).astype(np.int64)]
                        order = np.lexsort((s, level))[:keep]
                        first_common = int(np.searchsorted(level[order], RARE_LEVEL))
                        rare.append(s[order[:first_common]])
                        common.append(s[order[first_common:]])
                        counts.append(_signature(s))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, end - first),
                            pa.array(n, pa.int64()),
                            pa.array(np.array(fp1, np.uint64).view(np.int64)),
                            pa.array(np.array(fp2, np.uint64).view(np.int64)),
                            _lists(rare),
                            _lists(common),
                            pa.array(counts, pa.binary()),
                        ],
                        ["doc_id", "n", "fp1", "fp2", "rare", "common", "signature"],
                    )

        schema = "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, rare array<bigint>, common array<bigint>, signature binary"
        return keyed_texts(docs).mapInArrow(tidy(sign), schema)

    def _sets(self, texts: DataFrame, cells: str) -> DataFrame:
        """(cell, doc_id, shingles): the set of every document, once for each of its cells."""
        width = self.width

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, targets = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                for first, _, data, offsets in pieces(batch.column(1)):
                    rows: list[tuple[int, int, bytes]] = []
                    for k, s in enumerate(shingle_sets(*hash_words(data, offsets, NOT_BLANK), width), first):
                        for cell in targets[k] if len(s) else ():
                            rows.append((cell, ids[k], s.tobytes()))
                            if len(rows) * s.nbytes > BATCH_BYTES:
                                yield _batch(rows)
                                rows = []
                    if rows:
                        yield _batch(rows)

        chosen = texts.where(F.size(cells) > 0).select("doc_id", "text", cells)
        return chosen.mapInArrow(tidy(shingle), "cell bigint, doc_id bigint, shingles binary")

    # ---- cells too large for one task

    def _large_cells(self, sets: DataFrame) -> DataFrame:
        """Links in the cells of ``sets``, each larger than a leaf."""
        radius, percent, k = 1 - self.percent / 100, self.percent, self.pivots
        chosen = (
            sets.groupBy("cell", F.pmod(F.xxhash64("doc_id"), F.lit(k)).alias("slot"))
            .agg(F.min_by(F.struct("doc_id", "shingles"), F.xxhash64("doc_id", F.lit(1))).alias("p"))
            .groupBy("cell")
            .agg(F.sort_array(F.collect_list(F.struct("slot", "p"))).alias("p"))
            .select("cell", F.col("p.p.doc_id").alias("pivot_ids"), F.col("p.p.shingles").alias("pivot_sets"))
        )
        chosen = write_table(chosen, "pivots")

        def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                d = [
                    [_distance(_set(s), _set(p)) for p in ps]
                    for s, ps in zip(f["shingles"], f["pivot_sets"], strict=True)
                ]
                linked = [
                    [_linked(_set(s), _set(p), percent) for p in ps]
                    for s, ps in zip(f["shingles"], f["pivot_sets"], strict=True)
                ]
                yield pd.DataFrame(
                    {"cell": f["cell"], "doc_id": f["doc_id"], "pivot_ids": f["pivot_ids"], "d": d, "linked": linked}
                )

        pivot_rows = chosen.count()
        measured = write_table(
            sets.join(bounded_broadcast(chosen, pivot_rows, 20_000), "cell").mapInPandas(
                measure, "cell bigint, doc_id bigint, pivot_ids array<bigint>, d array<double>, linked array<boolean>"
            ),
            "measured",
        )
        to_pivots = measured.select(
            "doc_id", F.explode(F.arrays_zip("pivot_ids", "linked")).alias("p")
        ).where("p.linked AND doc_id <> p.pivot_ids")
        links = to_pivots.select(F.col("doc_id").alias("a"), F.col("p.pivot_ids").alias("b"))

        # which pivots are connected through a document: one row per cell and set of linked pivots
        mask = F.expr("aggregate(transform(linked, (l, i) -> IF(l, shiftleft(1L, i), 0L)), 0L, (s, x) -> s | x)")
        masked = measured.withColumn("mask", mask)
        patterns = masked.groupBy("cell", "mask").agg(F.count(F.lit(1)).alias("docs"))
        main = patterns.groupBy("cell").applyInPandas(_main_group, "cell bigint, main bigint")
        main = write_table(main, "main")
        placed = masked.join(bounded_broadcast(main, pivot_rows), "cell").select(
            "cell", "doc_id", "d", F.expr("(mask & main) <> 0").alias("core")
        )
        home = F.expr("array_position(d, array_min(d))")
        placed = write_table(placed.withColumn("home", home.cast("int")), "placed")

        # regions of the documents outside the main group: nearest pivot, then slices of the distance
        outside = placed.where("NOT core")
        block = max(1, self.leaf_docs // 3)
        slices = F.expr("CAST(floor(array_min(d) * 64) AS INT)")
        cut = outside.withColumn("slice", slices)
        counts = cut.groupBy("cell", "home", "slice").agg(F.count(F.lit(1)).alias("docs"))
        parts = F.ceil(F.col("docs") / block).cast("int")
        counts = counts.withColumn("parts", parts).drop("docs")
        cut = cut.join(written_broadcast(counts, "slices"), ["cell", "home", "slice"])
        cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        region = ["cell", "home", "slice", "part"]
        cut = write_table(cut.select(*region, "doc_id", "d"), "outside")
        bounds = cut.select(*region, F.posexplode("d").alias("j", "x")).groupBy(*region, "j").agg(
            F.min("x").alias("low"), F.max("x").alias("high")
        )
        bounds = bounds.groupBy(*region).agg(F.sort_array(F.collect_list(F.struct("j", "low", "high"))).alias("box"))
        bounds = write_table(bounds, "regions")
        region_rows = bounds.count()
        inside = F.expr(
            f"forall(zip_with(d, box, (x, b) -> x >= b.low - {radius + 1e-9}D AND x <= b.high + {radius + 1e-9}D), t -> t)"
        )
        near = (
            placed.drop("home").join(bounded_broadcast(bounds, region_rows, 20_000), "cell")
            .where(inside)
            .select(*region, "doc_id", "core")
        )
        near = write_table(near, "near")
        groups = near.groupBy(*region).agg(F.count(F.lit(1)).alias("docs"))
        salts = F.ceil(F.col("docs") / block).cast("int")
        groups = write_table(groups.select(*region, salts.alias("salts")), "groups")
        theirs = near.join(bounded_broadcast(groups, region_rows), region).select(
            *region,
            F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("salts")).cast("int").alias("salt"),
            "doc_id",
            "core",
            F.lit(False).alias("own"),
        )
        own = cut.join(bounded_broadcast(groups, region_rows), region).select(
            *region,
            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
            "doc_id",
            F.lit(False).alias("core"),
            F.lit(True).alias("own"),
        )
        key = F.xxhash64(*region, "salt").alias("key")
        pairs = theirs.union(own).select("cell", key, "doc_id", "core", "own")
        with_sets = pairs.join(sets, ["cell", "doc_id"]).select("key", "doc_id", "core", "own", "shingles")
        joined = with_sets.groupBy("key").applyInPandas(lambda g: _region_links(g, percent), "a bigint, b bigint")
        return links.union(write_table(joined, "links"))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cells, ids, sets = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(cells, pa.int64()), pa.array(ids, pa.int64()), pa.array(sets, pa.binary())],
        ["cell", "doc_id", "shingles"],
    )


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))


def _signature(s: np.ndarray) -> bytes:
    """How many shingles fall on each of a power of two of buckets, some eight to a bucket in large sets.

    A byte each: counts above 255 become 255, which takes them no further apart.
    """
    bits = max(SIGNATURE.bit_length() - 1, (len(s) // 8).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _levels(docs: DataFrame, width: int, counters: int) -> bytes:
    """Per counter the logarithm of the number of documents with a shingle that falls on it.

    A sketch of fixed size over all documents: any fixed order of shingles gives exact joins, and this one
    puts what many documents share last. The counts of many tasks are added in two steps, about the root of
    their number in a group each.
    """
    tasks = text_batches(docs).rdd.getNumPartitions()
    lanes = int(tasks**0.5) if tasks > ADDED_AT_ONCE else 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slot, texts = np.zeros(counters, np.uint16), np.uint64(counters - 1), 0
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column(0)):
                if texts + end - first >= 1 << 16:  # before a counter could overflow
                    yield emptied(table)
                    texts = 0
                texts += end - first
                hit = np.concatenate(list(shingle_sets(*hash_words(data, offsets, NOT_BLANK), width)))
                np.add.at(table, (hit & slot).astype(np.int64), np.uint16(1))
        yield emptied(table)

    def emptied(table: np.ndarray) -> pa.RecordBatch:
        blocks = [k for k in range(0, counters, SKETCH_BLOCK) if table[k : k + SKETCH_BLOCK].any()]
        smallest = np.min_scalar_type(int(table.max(initial=0)))
        codec = pa.Codec("zstd", 1)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([k // SKETCH_BLOCK for k in blocks], pa.int32()),
                pa.array([smallest.itemsize] * len(blocks), pa.int32()),
                pa.array([codec.compress(table[k : k + SKETCH_BLOCK].astype(smallest), asbytes=True) for k in blocks], pa.binary()),
            ],
            ["block", "bytes", "counts"],
        )
        table[:] = 0
        return out

    def total(g: pd.DataFrame) -> np.ndarray:
        out, codec = np.zeros(SKETCH_BLOCK, np.int64), pa.Codec("zstd", 1)
        for size, counts in zip(g["bytes"], g["counts"], strict=True):
            raw = codec.decompress(counts, SKETCH_BLOCK * size, asbytes=True)
            out += np.frombuffer(raw, f"<u{size}").astype(np.int64)
        return out

    def add(g: pd.DataFrame) -> pd.DataFrame:
        packed = pa.Codec("zstd", 1).compress(total(g).astype("<u8"), asbytes=True)
        return pd.DataFrame({"block": g["block"].iloc[:1], "bytes": [8], "counts": [packed]})

    def level(g: pd.DataFrame) -> pd.DataFrame:
        levels = np.floor(np.log2(np.maximum(total(g), 1))).astype(np.uint8)
        return pd.DataFrame({"block": g["block"].iloc[:1], "levels": [levels.tobytes()]})

    counted = text_batches(docs).select(F.col("text").cast("string")).mapInArrow(tidy(count), "block int, bytes int, counts binary")
    if lanes > 1:
        lane = F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("lane")
        counted = counted.select("*", lane).groupBy("block", "lane").applyInPandas(add, "block int, bytes int, counts binary")
    merged = counted.groupBy("block").applyInPandas(level, "block int, levels binary")
    out = np.zeros(counters, np.uint8)
    for row in merged.toLocalIterator():  # at most MAX_SKETCH bytes in all
        out[row["block"] * SKETCH_BLOCK :][:SKETCH_BLOCK] = np.frombuffer(row["levels"], np.uint8)
    return out.tobytes()


def _possible(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The documents of a cell with another one that bucket counts and sizes do not rule out."""
    g = g.sort_values(["n", "doc_id"])
    n = g["n"].to_numpy()
    raw = [np.frombuffer(s, np.uint8).astype(np.int32) for s in g["signature"]]
    width = np.array([len(r) for r in raw])
    counts, first = np.zeros((0, 0), np.int32), 0
    # at best the smaller set is contained in the larger one, so sizes alone bound the similarity
    reach = np.searchsorted(n, n * 100 // percent, "right")
    possible = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        later = slice(i + 1, int(reach[i]))
        if i == 0 or width[i] != width[i - 1]:
            # wider signatures of larger sets are folded to the width at hand
            some = raw[i : int(reach[width == width[i]].max())]
            counts, first = np.stack([r.reshape(width[i], -1).sum(axis=1) for r in some]), i
        apart = np.abs(counts[i + 1 - first : int(reach[i]) - first] - counts[i - first]).sum(axis=1)
        total = n[later] + n[i]
        # the union is (total + apart) / 2 and the intersection (total - apart) / 2, at best
        fits = 100 * (total - apart) >= percent * (total + apart)
        possible[later] |= fits
        possible[i] |= fits.any()
    return g.loc[possible, ["pivot", "doc_id"]]


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    shared = _shared(a, b)
    return 1 - shared / (len(a) + len(b) - shared)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = _shared(a, b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class _Groups:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.above = list(range(n))

    def top(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = x = self.above[self.above[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


class _Coded:
    """Sets of one group as small integers, so that a document meets all later ones in one gather."""

    def __init__(self, raw: list[bytes]) -> None:
        self.sets = [_set(r) for r in raw]
        self.n = np.array([len(s) for s in self.sets])
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        _, self.codes = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.mark = np.zeros(int(self.codes.max()) + 1, np.int64)

    def linked(self, i: int, first: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(link to i or not, distance to i) of the sets from ``first`` on."""
        own = self.codes[self.starts[i] : self.starts[i + 1]]
        self.mark[own] = 1
        hits = np.add.reduceat(self.mark[self.codes[self.starts[first] :]], self.starts[first:-1] - self.starts[first])
        self.mark[own] = 0
        union = self.n[i] + self.n[first:] - hits
        return 100 * hits >= percent * union, 1 - hits / union


def _leaf_links(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that connect all linked documents of a small cell; the cell's windows skip what cannot link."""
    g = g.sort_values("doc_id")
    ids, coded = g["doc_id"].to_numpy(), _Coded(list(g["shingles"]))
    groups, pairs, radius = _Groups(len(ids)), [], 1 - percent / 100 + 1e-9
    seen: list[np.ndarray] = []
    for i in range(len(ids) - 1):
        open_ = np.ones(len(ids) - i - 1, bool)
        for d in seen:
            open_ &= np.abs(d[i + 1 :] - d[i]) <= radius
        if not open_.any():
            continue
        linked, distance = coded.linked(i, i + 1, percent)
        for j in np.flatnonzero(linked) + i + 1:
            if groups.join(i, int(j)):
                pairs.append((ids[i], ids[j]))
        if len(seen) < 4:
            seen.append(np.concatenate([np.zeros(i + 1), distance]))
            seen[-1][: i + 1] = np.nan
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _region_links(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a region's own documents to each other and to those that the windows have added."""
    g = g.sort_values(["own", "core", "doc_id"], ascending=[False, False, True])
    ids, core, coded = g["doc_id"].to_numpy(), g["core"].to_numpy(), _Coded(list(g["shingles"]))
    groups, pairs = _Groups(len(ids)), []
    main = np.flatnonzero(core)
    for j in main[1:]:  # linked already, through the pivots
        groups.join(int(main[0]), int(j))
    for i in range(int(g["own"].sum())):
        if i + 1 < len(ids):
            for j in np.flatnonzero(coded.linked(i, i + 1, percent)[0]) + i + 1:
                if groups.join(i, int(j)):
                    pairs.append((ids[i], ids[j]))
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _main_group(g: pd.DataFrame) -> pd.DataFrame:
    """The connected group of pivots with the most documents, as a bit mask."""
    masks: list[list[int]] = []
    for mask, docs in zip(g["mask"].tolist(), g["docs"].tolist(), strict=True):
        if mask:
            joined = [mask, docs]
            for other in [m for m in masks if m[0] & mask]:
                masks.remove(other)
                joined = [joined[0] | other[0], joined[1] + other[1]]
            masks.append(joined)
    best = max(masks, key=lambda m: (m[1], m[0]), default=[0, 0])
    return pd.DataFrame({"cell": g["cell"].iloc[:1], "main": [best[0]]})
