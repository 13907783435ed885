"""Benchmark decontamination: a generalised suffix automaton of test items, met by streaming document words.

Words are runs of letters, digits and non-ASCII bytes with A-Z in lower case. The automaton holds every run
of consecutive words of every item. Streaming a document's words through it gives, after each word, the
longest run ending there that some item has; from ``span`` words on, or when it ends with the whole of a
shorter item, the words of that run are hit. Words no item has reset the automaton, so only stretches of
known words are streamed.

Automata are built by tasks, each over items of at most ``shard_words`` words, and written to the shared
folder. Documents are streamed past as many of them at a time as ``broadcast_words`` allows; further ones
mean further passes, each over what the one before has written, and the spans of all passes are united per
document.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.sparse_ftrl import free_name
from clickloom.llm.tables import text_batches
from clickloom.llm.words import ALNUM, FOLD, tidy
from clickloom.session import write_table

# words are blank-separated after this translation
_TO_WORDS = bytes(FOLD[b] if ALNUM[FOLD[b]] else 0x20 for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    raw = text if isinstance(text, bytes) else text.encode()
    return raw.translate(_TO_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences; ``span`` is the length of a window.

    A state stands for runs that end at the same places. ``full`` are the runs' longest lengths, ``link``
    the state of the longest suffix elsewhere. ``short`` lists, per state, the items shorter than a window
    that a run of the state ends with; ``windows`` the items that have the window ending the run.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], span: int) -> None:
        self.span = span
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.codes = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.full = [-1], [0]
        self.least = min((min(len(ws), span) for _, ws in items if ws), default=1)
        coded = [(i, [self.codes[w] for w in ws]) for i, ws in items if ws]
        for _, ws in coded:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        n = len(self.full)
        ends: list[set[int]] = [set() for _ in range(n)]
        whole: dict[int, list[tuple[int, int]]] = {}
        for item, ws in coded:
            state = 0
            for c in ws:
                state = self.next[state][c]
                ends[state].add(item)
            if len(ws) < span:
                whole.setdefault(state, []).append((len(ws), item))
        for state in sorted(range(1, n), key=lambda s: -self.full[s]):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.short: list[tuple] = [()] * n
        self.windows: list[tuple] = [()] * n
        for state in sorted(range(1, n), key=lambda s: self.full[s]):
            above = self.link[state]
            self.short[state] = tuple(whole.get(state, ())) + (self.short[above] if above > 0 else ())
            if self.full[state] >= span:
                far = above > 0 and self.full[above] >= span
                self.windows[state] = self.windows[above] if far else tuple(sorted(ends[state]))

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.full[known] == self.full[last] + 1 else self._split(last, c, known)
        new = self._state({}, 0, self.full[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.full[q] == self.full[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.full[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, following: dict[int, int], link: int, full: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.full.append(full)
        return len(self.full) - 1

    def spans(self, document: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Hit word ranges [start, end), sorted and merged, and the items whose windows occur."""
        codes = list(map(self.codes.get, document))
        n, found, items = len(codes), [], set()
        known = np.fromiter((c is not None for c in codes), bool, n)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._stream(codes, a, b, found, items)
        return found, items

    def _stream(self, codes: list, a: int, b: int, found: list[list[int]], items: set[int]) -> None:
        following, link, full, span = self.next, self.link, self.full, self.span
        state = length = 0
        for i in range(a, b):
            c = codes[i]
            while state and c not in following[state]:
                state = link[state]
                length = full[state]
            state = following[state].get(c, 0)
            length = length + 1 if state else 0
            reach = 0
            if length >= span:
                reach = length
                items.update(self.windows[state])
            for size, item in self.short[state]:
                if size <= length:
                    reach = max(reach, size)
                    items.add(item)
            if reach:
                start = i + 1 - reach
                while found and found[-1][1] >= start and found[-1][0] >= start:
                    found.pop()
                if found and found[-1][1] >= start:
                    found[-1][1] = i + 1
                else:
                    found.append([start, i + 1])


@dataclass(frozen=True)
class Decontaminator:
    """``span`` words in a row are contamination, and so is the whole of an item with fewer words."""

    span: int = 10
    shard_words: int = 50_000
    broadcast_words: int = 200_000  # some 100 MB of automata, of which a worker holds one pass

    def automata(self, benchmark: DataFrame) -> DataFrame:
        """(shard, words, automaton) over all items; missing or empty texts have no words, missing ids no item.

        An item with repeated rows counts once with each of its texts. An item longer than a shard is a
        shard of its own.
        """
        span = self.span
        items = benchmark.select(
            F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")
        ).where("item_id IS NOT NULL AND text IS NOT NULL")
        size = F.floor(F.length("text") / 2) + 1  # no fewer than its words
        total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        shards = max(1, -(-total // self.shard_words))
        if shards > 1:
            # rows of one item may be many, and hits are united by item
            shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
        else:
            shard = F.lit(0)

        def build(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["item_id", "text"])
            split = [(i, words(t)) for i, t in zip(g["item_id"].tolist(), g["text"], strict=True)]
            made = pickle.dumps(Automaton(split, span), protocol=5)
            count = sum(len(ws) for _, ws in split)
            return pd.DataFrame({"shard": g["shard"].iloc[:1], "words": [count], "automaton": [made]})

        rows = items.withColumn("shard", shard.cast("bigint"))
        return write_table(
            rows.groupBy("shard").applyInPandas(build, "shard bigint, words bigint, automaton binary"), "automata"
        )

    def passes(self, benchmark: DataFrame) -> list[list[int]]:
        """Numbers of the shards that are broadcast together, with the written automata."""
        made = self.automata(benchmark)
        groups: list[list[int]] = [[]]
        held = 0
        for row in made.select("shard", "words").orderBy("shard").toLocalIterator():
            if groups[-1] and held + row["words"] > self.broadcast_words:
                groups.append([])
                held = 0
            groups[-1].append(row["shard"])
            held += row["words"]
        self_made = [made.where(F.col("shard").isin(g)) for g in groups]
        return self_made

    def scan(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """``docs`` with all columns and a struct ``_hits``: n_words, spans (word ranges), items.

        A null text has no words. Repeated rows are scanned one by one.
        """
        name = free_name(docs, "_hits")
        field = T.StructType(
            [
                T.StructField("n_words", T.LongType()),
                T.StructField("starts", T.ArrayType(T.LongType())),
                T.StructField("ends", T.ArrayType(T.LongType())),
                T.StructField("items", T.ArrayType(T.LongType())),
            ]
        )
        kind = pa.struct(
            [("n_words", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("starts", "ends", "items")]]
        )
        column = docs.columns.index("text")
        shared = None
        for automata in self.passes(benchmark):
            if shared is not None:
                # a pass is over before the next one's automata are sent
                docs = write_table(docs, "pass")
                shared.unpersist()
            # within broadcast_words
            raw = [bytes(r["automaton"]) for r in automata.toLocalIterator()]
            shared = docs.sparkSession.sparkContext.broadcast(raw)
            again = name in docs.columns

            def run(batches: Iterator[pa.RecordBatch], shared=shared, again=again) -> Iterator[pa.RecordBatch]:
                machines = [pickle.loads(r) for r in shared.value]
                for batch in batches:
                    texts = batch.column(column).cast(pa.binary())
                    before = batch.column(batch.schema.get_field_index(name)) if again else [None] * len(texts)
                    out = []
                    for text, old in zip(texts, before, strict=True):
                        ws = words(text.as_py())
                        spans, items = [], set()
                        for machine in machines:
                            s, i = machine.spans(ws)
                            spans += s
                            items |= i
                        if again:
                            old = old.as_py()
                            spans += [list(p) for p in zip(old["starts"], old["ends"], strict=True)]
                            items |= set(old["items"])
                        spans = merged(spans)
                        out.append(
                            {
                                "n_words": len(ws),
                                "starts": [s for s, _ in spans],
                                "ends": [e for _, e in spans],
                                "items": sorted(items),
                            }
                        )
                    kept = batch.columns[: len(batch.columns) - again]
                    names = batch.schema.names[: len(kept)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kind)], [*names, name])

            base = [f for f in docs.schema.fields if f.name != name]
            docs = text_batches(docs).mapInArrow(tidy(run), T.StructType([*base, T.StructField(name, field)]))
        return docs

    def report(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        hits = self.scan(texts, benchmark)
        h = F.col("_hits")
        n_hit = F.aggregate(
            F.zip_with(h["starts"], h["ends"], lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x
        )
        listed = F.array_join(F.sort_array(F.transform(h["items"], lambda i: i.cast("string"))), ",")
        return hits.select(
            "doc_id",
            h["n_words"].alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(h["items"]).cast("bigint").alias("n_items"),
            F.sha2(listed, 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )

    def remove(self, docs: DataFrame, benchmark: DataFrame, most: float = 0.5) -> DataFrame:
        """``docs`` without the hit words and what stands between the words of a span.

        A document of which more than ``most`` of the words are hit goes as a whole. Texts without hits
        stay as they are to the last byte, null included.
        """
        name = free_name(docs, "_hits")
        columns = docs.columns
        h = F.col(name)
        hits = self.scan(docs, benchmark)
        n_hit = F.aggregate(
            F.zip_with(h["starts"], h["ends"], lambda s, e: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x
        )
        kept = hits.where(n_hit <= most * h["n_words"])
        at, where = columns.index("text"), len(columns)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at)
                starts = pc.struct_field(batch.column(where), "starts")
                ends = pc.struct_field(batch.column(where), "ends")
                touched = np.flatnonzero(np.asarray(pc.list_value_length(starts).fill_null(0)))
                if len(touched):
                    values = texts.to_pylist()
                    for k in touched.tolist():
                        values[k] = without(values[k], starts[k].as_py(), ends[k].as_py())
                    texts = pa.array(values, texts.type)
                out = list(batch.columns[:where])
                out[at] = texts
                yield pa.RecordBatch.from_arrays(out, batch.schema.names[:where])

        return kept.mapInArrow(tidy(cut), docs.schema)


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Ranges sorted and united where they meet."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def without(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the ranges, from a span's first byte to its last."""
    raw = text.encode()
    inside = ALNUM[FOLD[np.frombuffer(raw, np.uint8)]]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(raw[at : first[s]])
        at = last[e - 1]
    out.append(raw[at:])
    return b"".join(out).decode()


def digest(items: list[int]) -> str:
    """The digest of a set of items as ``report`` gives it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
