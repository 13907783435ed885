"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are integers. A block of candidates has, for every dimension, its rows sorted by that component.
A query walks all lists at the same depth, each from the end that favours it: from the largest component
for a positive weight, from the smallest for a negative one. Rows met for the first time are scored in
full. No row still unseen can score more than the sum of weight times component at the present depth, so
the walk stops once that sum is below the k-th best score; while it is equal, a row with a smaller id might
still come.

Candidates are dealt to blocks by a hash of their ids, queries likewise; a task joins one block of either
kind, and the best of the blocks meet per query, k rows from each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import write_table

FIRST_DEPTH = 8


class SortedLists:
    """A block of candidate vectors with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # what tells rows with the same id apart
        self.rows = self.ids if rows is None else rows[order]
        self.floats = self.vectors.astype(np.float64)
        # rows in ascending order of each component
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.lists, axis=0)

    def top(self, key: int, query: np.ndarray, k: int) -> tuple[list[int], list[int], int]:
        """(ids, scores) of the best k rows other than the row ``key``, ties to smaller ids; rows scored."""
        n, used = len(self.ids), np.flatnonzero(query)
        weights = query[used]
        seen = np.zeros(n, bool)
        scores = np.full(n, np.iinfo(np.int64).min)
        own = self.rows == key
        seen[own] = True
        depth, step = 0, FIRST_DEPTH
        # lists of the weights that favour large components are read from their ends
        falling = weights > 0
        exact = np.abs(query).sum() * max(1, np.abs(self.vectors).max(initial=0)) < 2**53
        while depth < n:
            ahead = min(n, depth + step)
            rows = np.where(falling[None, :], self.lists[n - ahead : n - depth, used][::-1], self.lists[depth:ahead, used])
            met = seen.copy()
            met[rows] = True
            fresh = np.flatnonzero(met & ~seen)
            seen = met
            if len(fresh):
                table, weight = (self.floats, query.astype(np.float64)) if exact else (self.vectors, query)
                scores[fresh] = (table[fresh] @ weight).astype(np.int64)
            depth, step = ahead, step * 2
            if depth < n:
                at = np.where(falling, self.sorted[n - depth, used], self.sorted[depth - 1, used])
                bound = int(weights @ at)
                found = scores[seen & ~own]
                if len(found) >= k:
                    kth = int(np.partition(found, len(found) - k)[len(found) - k])
                    if bound < kth:
                        break
        if len(used) == 0:  # nothing to walk: every row scores 0
            seen[:] = True
            scores[:] = 0
        open_ = np.flatnonzero(seen & ~own)
        best = open_[np.lexsort((self.ids[open_], -scores[open_]))[:k]]
        return self.ids[best].tolist(), scores[best].tolist(), int(seen.sum())


@dataclass(frozen=True)
class ThresholdSearch:
    """``k`` best rows per query; ``block_rows`` candidates and ``query_rows`` queries meet in a task."""

    k: int = 5
    block_rows: int = 4_000
    query_rows: int = 2_000

    def search(self, vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "vector") -> DataFrame:
        """(query_id, rank, vec_id, score) of rows (key, vector array<bigint>); a row is not its own candidate.

        Rows with a missing key, a missing vector or a missing component take no part. Rows with the same
        key are candidates and queries one by one, so they meet each other and their ranks stand side by side.
        A query with fewer candidates than ``k`` gets all, one without any no row. Vectors of another length
        than the query's do not meet it.
        """
        rows = vectors.select(
            F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<bigint>").alias("v"), is_query.alias("q")
        ).where("id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
        rows = write_table(
            rows.withColumns({"size": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors"
        )
        total, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0))).first()
        blocks, parts = max(1, -(-total // self.block_rows)), max(1, -(-asked // self.query_rows))
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int")
        candidates = rows.select(
            "size", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "row", "id", "v",
            F.lit(False).alias("asks"),
        )
        queries = rows.where("q").select(
            "size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), "row", "id", "v",
            F.lit(True).alias("asks"),
        )
        k = self.k

        def join(g: pd.DataFrame) -> pd.DataFrame:
            asks = g["asks"].to_numpy()
            out = []
            if asks.any() and not asks.all():
                ids, own, stacked = g["id"].to_numpy(), g["row"].to_numpy(), np.array(g["v"].tolist(), np.int64).reshape(len(g), -1)
                lists = SortedLists(ids[~asks], stacked[~asks], own[~asks])
                for row, key_, query in zip(own[asks].tolist(), ids[asks].tolist(), stacked[asks], strict=True):
                    found, scores, _ = lists.top(row, query, k)
                    out += [(row, key_, i, s) for i, s in zip(found, scores, strict=True)]
            return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"], dtype="int64")

        best = (
            candidates.union(queries)
            .groupBy("size", "block", "part")
            .applyInPandas(join, "row bigint, query_id bigint, vec_id bigint, score bigint")
        )
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantized(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of every component; null where one is missing or not finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(finite, whole).alias("vector"))
