"""Suffix-array dedup: removes every byte of a text that a string of set length covers which starts elsewhere too.

Sorting all suffixes of all texts would move every text hundreds of times, so suffixes are sorted only where
sorting can tell something:

1. Every start of a string of ``length`` bytes belongs to an anchor: the place in its first ``window`` bytes
   whose eight bytes have the least hash, the first of equals. Equal strings have the same anchor, so the
   starts of an anchor, with the bytes up to the end of their last string, are one *context*, and equal strings
   lie in contexts whose bytes from the anchor on agree for ``length - window + 1`` bytes, their *lead*.
2. Leads seen once hold nothing that repeats. Where all contexts of a lead are alike, all of their starts repeat.
3. The suffixes of all other contexts, one of each kind with its number, are range-partitioned by their leads
   with sampled splitters. Every bucket sorts its suffixes by multikey quicksort, eight bytes at a time; those
   still together after ``length`` bytes are equal. Leads that a splitter cuts, which are those too common for
   one bucket, are compared across the boundary: in pieces of a few starts, which mostly are all alike or alone,
   and suffix by suffix where they are not. So no group has to fit into a task.

Contexts, texts and, across boundaries, suffixes are told apart by 128 bits of a cryptographic hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clickloom.llm.tables import bounded_broadcast, keyed_texts
from clickloom.llm.words import mix, tidy
from clickloom.session import delete_directory, new_path, write_table

# starts of one text that are looked at together
_STRETCH = 1 << 20

# bytes of contexts in a bucket of suffixes
_BUCKET_BYTES = 1 << 22

# starts in a piece of a context that is compared across boundaries: a context has about 128, and most of its
# pieces need no closer look, so about the root of that keeps pieces and closer looks equally few
_PIECE = 8

# leads cut by splitters, at most one for each bucket, that may be broadcast
_CUT_ROWS = 100_000

# bytes of texts worth a task of every step, and tasks for each core where these are fewer: small partitions are written
# together, for every file has a price, and where Hadoop has no native library it starts a process for each local one
_TASK_BYTES = 1 << 23
_TASKS_A_CORE = 4

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _eights(data: np.ndarray, n: int, order: str) -> np.ndarray:
    """The eight bytes from each of the first ``n`` places on, zeros behind the end, as unsigned numbers."""
    padded = np.zeros(-(-(n + 15) // 8) * 8 + 8, np.uint8)
    padded[: len(data)] = data[: len(padded)]
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        own = out[k::8]
        own[:] = np.frombuffer(padded, f"{order}u8", len(own), k)
    return out


def anchored(data: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor) of every stretch of starts with one anchor, in order."""
    gram = min(8, length - window + 1)
    starts = len(data) - length + 1
    found = []
    for at in range(0, starts, _STRETCH):
        n = min(_STRETCH, starts - at)
        m = n + window - 1
        eights = _eights(data[at : at + m + gram - 1], m, "<")
        if gram < 8:
            eights &= np.uint64((1 << 8 * gram) - 1)
        # the place in the low bits makes the first of equals the least
        ranked = (mix(eights + np.uint64(1)) >> np.uint64(24) << np.uint64(23)) | np.arange(m, dtype=np.uint64)
        blocks = np.full(-(-m // window) * window, np.iinfo(np.uint64).max, np.uint64)
        blocks[:m] = ranked
        blocks = blocks.reshape(-1, window)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], before[window - 1 : window - 1 + n])
        anchor = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
        heads = np.flatnonzero(np.diff(anchor, prepend=-1))
        found.append((heads + at, np.diff(heads, append=n), anchor[heads] + at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_ANCHORS = "row binary, key bigint, d1 bigint, d2 bigint, starts int, anchor int, places array<int>"


def _anchor_rows(length: int, window: int):
    """Function from batches (row, text bytes) to the kinds of contexts of each text and where they begin."""
    lead = length - window + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, digests, starts, anchors, places = [], [], [], [], [], []
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                if len(raw) < length:
                    continue
                kinds: dict[bytes, list[int]] = {}
                found = anchored(np.frombuffer(raw, np.uint8), length, window)
                for start, n, anchor in zip(*[x.tolist() for x in found], strict=True):
                    digest = hashlib.blake2b(raw[start : start + n - 1 + length], digest_size=16).digest()
                    if digest in kinds:
                        kinds[digest].append(start)
                        continue
                    places.append(kinds.setdefault(digest, [start]))
                    rows.append(row)
                    keys.append(xxhash.xxh3_64_intdigest(raw[anchor : anchor + lead]))
                    digests.append(digest)
                    starts.append(n)
                    anchors.append(anchor - start)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.binary()),
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array(halves[:, 0].copy()),
                    pa.array(halves[:, 1].copy()),
                    pa.array(starts, pa.int32()),
                    pa.array(anchors, pa.int32()),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                ["row", "key", "d1", "d2", "starts", "anchor", "places"],
            )

    return tidy(scan)


_CONTEXTS = "d1 bigint, d2 bigint, n bigint, starts int, anchor int, lead binary, content binary"


def _cut_contexts(length: int, window: int):
    """Function from batches (text bytes, wanted contexts) to the contexts themselves."""
    lead = length - window + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = raw.as_py()
                for w in wanted:
                    at, anchor = w["place"], w["place"] + w["anchor"]
                    content = raw[at : at + w["starts"] - 1 + length]
                    out.append((w["d1"], w["d2"], w["n"], w["starts"], w["anchor"], raw[anchor : anchor + lead], content))
            kinds = [*[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.binary()] * 2]
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["d1", "d2", "n", "starts", "anchor", "lead", "content"],
            )

    return tidy(cut)


def repeated_suffixes(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Those of the places whose next ``length`` bytes stand at another of the places too.

    Multikey quicksort with tokens of eight bytes: suffixes that agree so far form a segment, only segments
    in which the next token varies are sorted by it and split, and suffixes left alone are done with.
    """
    tokens = _eights(data, len(data), ">")
    heads = np.zeros(len(places), bool)
    heads[:1] = True
    for depth in range(0, length, 8):
        if not len(places):
            break
        token = tokens[places + depth]
        if length - depth < 8:
            token >>= np.uint64(8 * (8 - length + depth))
        varies = (token[1:] != token[:-1]) & ~heads[1:]
        if varies.any():
            segment = np.cumsum(heads)
            unsorted = np.zeros(segment[-1] + 1, bool)
            unsorted[segment[1:][varies]] = True
            rows = np.flatnonzero(unsorted[segment])
            order = np.argsort(token[rows], kind="stable")
            order = rows[order[np.argsort(segment[rows][order], kind="stable")]]
            places[rows], token[rows] = places[order], token[order]
            heads[1:] |= token[1:] != token[:-1]
            kept = ~(heads & np.append(heads[1:], True))
            places, heads = places[kept], heads[kept]
    return places


_MARKS = "d1 bigint, d2 bigint, first int, last int"


def _sort_bucket(length: int):
    """Function from a bucket of contexts to the first and the last repeated start of those that have one."""

    def mark(bucket: pa.Table) -> pa.Table:
        contents = bucket.column("content").to_pylist()
        starts = bucket.column("starts").to_numpy().astype(np.int64)
        base = np.concatenate([[0], np.cumsum([len(c) for c in contents])])[:-1].astype(np.int64)
        data = np.frombuffer(b"".join(contents), np.uint8)
        before = np.cumsum(starts) - starts
        places = np.repeat(base - before, starts) + np.arange(int(starts.sum()))
        repeated = np.sort(repeated_suffixes(data, places, length))
        owner = np.searchsorted(base, repeated, "right") - 1
        first, last = np.full(len(contents), -1), np.full(len(contents), -1)
        # the last assignment to a place counts
        last[owner] = repeated - base[owner]
        first[owner[::-1]] = (repeated - base[owner])[::-1]
        often = bucket.column("n").to_numpy() > 1
        first[often], last[often] = 0, starts[often] - 1
        held = np.flatnonzero(first >= 0)
        ids = bucket.select(["d1", "d2"]).take(pa.array(held))
        return pa.table(
            {
                "d1": ids.column("d1"),
                "d2": ids.column("d2"),
                "first": pa.array(first[held], pa.int32()),
                "last": pa.array(last[held], pa.int32()),
            }
        )

    return mark


_KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; those that touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of the merged spans."""
    edges = [0, *[e for span in spans for e in span], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text bytes, covered ranges) to what is left of each text."""
    for batch in batches:
        out = []
        for key, raw, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw, spans = raw.as_py(), merged([(r["from"], r["to"]) for r in ranges or ()])
            gone = sum(b - a for a, b in spans)
            out.append((key, len(raw), gone, len(spans), hashlib.sha256(without(raw, spans)).hexdigest()))
        columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


@dataclass(frozen=True)
class SuffixDedup:
    """Removal of the bytes that strings of ``length`` bytes cover which start more than once in the corpus.

    ``bucket_bytes`` is the size of a bucket of suffixes; results do not depend on it.
    """

    length: int = 400
    bucket_bytes: int = _BUCKET_BYTES

    @property
    def window(self) -> int:
        """Starts among which an anchor is chosen; the lead is what is left of ``length``, and one byte."""
        return max(1, self.length * 16 // 25)

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

        Missing texts are empty. Rows that are repeated, ids included, are each other's elsewhere. Texts below
        ``length`` bytes stay whole, rows without an id are rows like others, and no rows give none.
        """
        texts = self._texts(docs)
        spans, tasks = self._written(texts)
        joined = texts.join(spans, "row", "left").select("doc_id", "raw", "ranges")
        return joined.mapInArrow(tidy(_digests), _KEPT).coalesce(tasks)

    def spans(self, docs: DataFrame) -> DataFrame:
        """(row, ranges) of the texts that lose something; ranges of bytes may overlap. Written in the shared folder.

        ``row`` names the pair of id and text, so equal rows share one.
        """
        return self._written(self._texts(docs))[0]

    def _written(self, texts: DataFrame) -> tuple[DataFrame, int]:
        """The ranges, and the number of tasks that wrote them at most."""
        conf, before = texts.sparkSession.conf, texts.sparkSession.conf.get(_CLEANUP)
        # steps are written, so what a step has shuffled is of no use behind it
        conf.set(_CLEANUP, "true")
        try:
            return self._spans(texts)
        finally:
            conf.set(_CLEANUP, before)

    @staticmethod
    def _texts(docs: DataFrame) -> DataFrame:
        name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text")
        row = F.unhex(F.left(F.sha2(name, 256), F.lit(32)))
        filled = keyed_texts(docs).fillna("", ["text"])
        return filled.select(row.alias("row"), "doc_id", F.col("text").cast("binary").alias("raw"))

    def _spans(self, texts: DataFrame) -> tuple[DataFrame, int]:
        spark, length = texts.sparkSession, self.length
        path, size = new_path(spark, "anchors"), Observation()
        counted = texts.select("row", "raw").observe(size, F.sum(F.length("raw")).alias("bytes"))
        anchors = write_table(counted.mapInArrow(_anchor_rows(length, self.window), _ANCHORS), "anchors", path)
        tasks = -(-(size.get.get("bytes") or 0) // _TASK_BYTES)
        tasks = max(_TASKS_A_CORE * spark.sparkContext.defaultParallelism, tasks)
        times: Column = F.sum(F.size("places")).alias("n")
        alike = (F.min("d1") == F.max("d1")) & (F.min("d2") == F.max("d2"))
        leads = write_table(
            anchors.groupBy("key").agg(times, (~alike).alias("mixed")).where("n > 1").select("key", "mixed"),
            "leads", tasks=tasks,
        )
        shared = write_table(anchors.join(leads, "key").drop("key"), "shared-anchors", tasks=tasks)
        delete_directory(spark, path)

        marks = self._marks(self._contexts(texts, shared.where("mixed"), tasks), tasks)
        sure = shared.where("NOT mixed").withColumns({"first": F.lit(0), "last": F.col("starts") - 1})
        found = sure.drop("d1", "d2").unionByName(shared.where("mixed").join(marks, ["d1", "d2"]).drop("d1", "d2"))
        covered = found.select("row", F.explode("places").alias("place"), "first", "last").select(
            "row",
            F.struct(
                (F.col("place") + F.col("first")).alias("from"), (F.col("place") + F.col("last") + length).alias("to")
            ).alias("range"),
        )
        ranges = covered.groupBy("row").agg(F.collect_set("range").alias("ranges"))
        return write_table(ranges, "covered", tasks=tasks), tasks

    def _contexts(self, texts: DataFrame, shared: DataFrame, tasks: int) -> DataFrame:
        """One context of each kind, with its number of places."""
        place = F.struct("row", F.get("places", F.lit(0)).alias("place"), "starts", "anchor")
        kinds = shared.groupBy("d1", "d2").agg(F.sum(F.size("places")).alias("n"), F.min(place).alias("at"))
        one = F.struct("d1", "d2", "n", "at.place", "at.starts", "at.anchor")
        wanted = kinds.groupBy("at.row").agg(F.collect_list(one).alias("wanted"))
        # equal rows would give the same contexts again
        once = texts.select("row", "raw").dropDuplicates(["row"])
        cut = once.join(wanted, "row").select("raw", "wanted")
        return write_table(cut.mapInArrow(_cut_contexts(self.length, self.window), _CONTEXTS), "contexts", tasks=tasks)

    def _marks(self, contexts: DataFrame, tasks: int) -> DataFrame:
        """(d1, d2, first, last): the first and the last repeated start of the contexts that have one.

        All starts between them are covered with these, since they are less than ``length`` apart.
        """
        total = contexts.agg(F.sum(F.length("content"))).first()[0] or 0
        buckets = -(-total // self.bucket_bytes) or 1
        ranged = write_table(
            contexts.repartitionByRange(buckets, "lead", "d1", "d2").withColumn("bucket", F.spark_partition_id()),
            "suffix-buckets", tasks=tasks,
        )
        ends = ranged.groupBy("bucket").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
        cut = write_table(
            ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("lead"))
            .groupBy("lead").count().where("count > 1").select("lead"),
            "cut-leads", tasks=tasks,
        )
        cut = bounded_broadcast(cut, cut.count(), _CUT_ROWS)
        inside = ranged.join(cut, "lead", "left_anti").groupBy("bucket").applyInArrow(_sort_bucket(self.length), _MARKS)
        across = self._across(ranged.join(cut, "lead", "left_semi"), tasks)
        return write_table(inside.unionByName(across), "marks", tasks=tasks)

    def _across(self, contexts: DataFrame, tasks: int) -> DataFrame:
        """The same for contexts whose leads stand in several buckets.

        A piece holds starts at like distances from their anchors. Its core is what all of its strings share:
        pieces whose core is seen once hold nothing that repeats, and where all pieces of a core are the same,
        all of their starts do. Only the strings of other pieces, one of each kind, are counted by themselves.
        """
        length, size = self.length, min(_PIECE, self.length)
        numbers = f"sequence(int((anchor - starts + 1) div {size}), int(anchor div {size}))"
        parted = contexts.select("*", F.explode(F.expr(numbers)).alias("part")).selectExpr(
            "*",
            f"greatest(0, anchor - part * {size} - {size - 1}) AS low",
            f"least(starts - 1, anchor - part * {size}) AS high",
        )
        pieces = write_table(
            parted.select(
                "d1", "d2", "n", "part", "low", "high", F.expr("anchor - low").alias("reach"),
                _named(f"substring(content, anchor - part * {size} + 1, {length - size + 1})").alias("core"),
                _named(f"substring(content, low + 1, high - low + {length})").alias("whole"),
            ),
            "pieces", tasks=tasks,
        )
        alike = (F.min("whole") == F.max("whole")) & (F.min("reach") == F.max("reach"))
        cores = write_table(
            pieces.groupBy("part", "core").agg(F.sum("n").alias("n"), (~alike).alias("mixed")).where("n > 1").drop("n"),
            "cores", tasks=tasks,
        )
        shared = write_table(pieces.join(cores, ["part", "core"]), "shared-pieces", tasks=tasks)
        mixed, kind = shared.where("mixed"), ["part", "reach", "whole"]
        kinds = mixed.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("d1", "d2", "low", "high")).alias("at"))
        strings = kinds.select(*kind, "n", "at.*").join(contexts.select("d1", "d2", "content"), ["d1", "d2"])
        every = write_table(
            strings.select(*kind, "n", "low", "content", F.explode(F.expr("sequence(low, high)")).alias("at")).select(
                *kind, "n", F.expr("at - low").alias("step"), _named(f"substring(content, at + 1, {length})").alias("suffix")
            ),
            "cut-suffixes", tasks=tasks,
        )
        often = write_table(
            every.groupBy("suffix").agg(F.sum("n").alias("n")).where("n > 1").select("suffix"),
            "repeated-suffixes", tasks=tasks,
        )
        # written, so that a kind of many pieces can be split where they meet
        steps = write_table(
            every.join(often, "suffix").groupBy(*kind).agg(F.min("step").alias("first"), F.max("step").alias("last")),
            "repeated-steps", tasks=tasks,
        )
        found = mixed.join(steps, kind).selectExpr("d1", "d2", "low + first AS first", "low + last AS last")
        sure = shared.where("NOT mixed").selectExpr("d1", "d2", "low AS first", "high AS last")
        return sure.unionByName(found).groupBy("d1", "d2").agg(
            F.min("first").cast("int").alias("first"), F.max("last").cast("int").alias("last")
        )


def _named(content: str) -> Column:
    """128 bits of the SHA-256 of some bytes."""
    return F.unhex(F.left(F.sha2(F.expr(content), 256), F.lit(32)))
