"""Prefix trie of rebuilt conversations, from fingerprints that are combined instead of rebuilt texts.

A sequence of turns has the fingerprint (sum of e(k) * B^(k-1), B^length) modulo a prime, where e(k) is a number
drawn for its k-th turn: a monoid in which the fingerprint of two sequences in a row follows from theirs. A
conversation rebuilt from the head of another and its own rest therefore gets the fingerprints of all its
prefixes from running sums of the two originals. Turns are held as references to the first turn of the same
role and text; texts are read once, to find these.

Prefixes with the same fingerprints under three primes form a node. That they are equal is then verified: all
members of a node must end in the same reference and have their parents in one node, which proves equality from
the root downwards. Should it ever fail, other numbers are drawn.

Nodes with the same smallest member follow one another, so they form chains, and the chains a tree of their own.
Sums over subtrees are sums over chains and what hangs on them: totals of chains are gathered by doubling, with
as many rounds as the logarithm of the chains' height, and running sums along the chains do the rest.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.words import tidy
from clickloom.operators.running import running
from clickloom.session import write_table

# the three largest primes below 2^31, so that products fit into a bigint
PRIMES = (2147483647, 2147483629, 2147483587)

# bits of a position
_BITS = 40

# ids in one piece of a node's list
_PIECE_IDS = 20_000

_MARKS = ("h0", "h1", "h2")
_ABOVE = ("p0", "p1", "p2")
_SUMS = ("s0", "s1", "s2")


def _power(base: int, prime: int, exponent: str) -> str:
    """SQL of base^exponent modulo prime for an exponent of at least 0."""
    squares = ", ".join(f"{pow(base, 1 << k, prime)}L" for k in range(_BITS))
    bit = f"pmod(shiftright({exponent}, i), 2) = 1"
    return (
        f"aggregate(sequence(0, length(bin({exponent})) - 1), 1L, "
        f"(a, i) -> if({bit}, a * element_at(array({squares}), i + 1) % {prime}, a))"
    )


def _pieces(keys: int):
    """Function from rows (keys..., conv_id) in order to lists of ids of one key, as text, with the first of each."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def close() -> None:
            out.append((*key, ids[0], ",".join(map(str, ids))))

        def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * (keys + 2)
            fields = [*[(n, pa.int64()) for n in schema.names[:keys]], ("first", pa.int64()), ("ids", pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

        schema = None
        for batch in batches:
            schema = batch.schema
            for *own, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ids and (own != key or len(ids) == _PIECE_IDS):
                    close()
                    ids = []
                key = own
                ids.append(conv)
            yield batch_of(out, schema)
            out.clear()
        if ids:
            close()
            yield batch_of(out, schema)

    return tidy(pieces)


def _hashes(keys: int):
    """Function from pieces (keys..., ids) in order to the SHA-256 of each key's whole list, one state at a time."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, names = None, None, [], []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * (keys + 1)
            kinds = [pa.int64()] * keys + [pa.string()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, [*names, "ends_sha256"])

        for batch in batches:
            names = batch.schema.names[:keys]
            for *own, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(ids.encode())
            yield batch_of()
        if key is not None:
            out.append((*key, state.hexdigest()))
            yield batch_of()

    return tidy(hashes)


@dataclass(frozen=True)
class PrefixTrie:
    """Trie over conversations rebuilt from the head of the first of their ``family`` ids and their own rest.

    The head has crc32(id as text) mod ``heads`` turns. ``drawn`` chooses the numbers behind the fingerprints;
    results do not depend on it.
    """

    family: int = 5
    heads: int = 9
    drawn: int = 1

    def nodes(self, conversations: DataFrame) -> DataFrame:
        """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node.

        Turns are ordered by turn, a missing one first; turns with the same number by role, then text. A missing
        role or text is empty. Rows without conv_id belong to no conversation, repeated rows are further turns,
        other columns are not looked at, and without conversations there are no nodes. For negative ids the
        first of the family is the one nearer to zero.
        """
        turns = self._turns(conversations)
        drawn = self.drawn
        while True:
            members = self._members(self._prefixes(turns, drawn), drawn)
            nodes = self._groups(members)
            if nodes.where("NOT verified").isEmpty():
                break
            drawn += 1
        return self._trie(nodes, members)

    def _turns(self, conversations: DataFrame) -> DataFrame:
        """(conv_id, pos, ref_conv, ref_pos, bytes) of every turn; the reference is the first turn of that role and text."""
        rows = conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
        )
        placed = write_table(running(rows, ["turn", "role", "text"], by=["conv_id"], number="pos"), "turns")
        first = F.min(F.struct("conv_id", "pos")).alias("first")
        kinds = write_table(placed.groupBy("role", "text").agg(first), "turn-kinds")
        referred = placed.join(kinds, ["role", "text"]).select(
            "conv_id",
            "pos",
            F.col("first.conv_id").alias("ref_conv"),
            F.col("first.pos").alias("ref_pos"),
            F.octet_length("text").cast("bigint").alias("bytes"),
        )
        return write_table(referred, "turn-references")

    @staticmethod
    def _bases(drawn: int) -> list[int]:
        rng = random.Random(drawn)
        return [rng.randrange(1 << 20, p) for p in PRIMES]

    @staticmethod
    def _number(k: int, drawn: int) -> str:
        """SQL of the number of a turn under the k-th prime."""
        return f"(1 + pmod(xxhash64(ref_conv, ref_pos, {1000 * drawn + k}), {PRIMES[k] - 1}))"

    def _prefixes(self, turns: DataFrame, drawn: int) -> DataFrame:
        """The turns with the fingerprints s0, s1, s2 of the original conversation up to and including them."""
        bases = self._bases(drawn)
        sums = {
            name: F.expr(f"{self._number(k, drawn)} * {_power(bases[k], PRIMES[k], '(pos - 1)')} % {PRIMES[k]}")
            for k, name in enumerate(_SUMS)
        }
        summed = running(turns, ["pos"], by=["conv_id"], sums=sums)
        return write_table(
            summed.withColumns({name: F.col(name) % PRIMES[k] for k, name in enumerate(_SUMS)}), "prefixes"
        )

    def _members(self, prefixes: DataFrame, drawn: int) -> DataFrame:
        """A row per rebuilt conversation and depth: its fingerprint, its parent's, its last turn, whether it ends there."""
        bases = self._bases(drawn)
        most = self.heads - 1
        entry = F.struct("pos", *_SUMS, "ref_conv", "ref_pos", "bytes")
        begun = prefixes.groupBy("conv_id").agg(
            F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") <= most, entry))).alias("begin")
        )
        head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(self.heads))
        own = write_table(
            begun.withColumns({"h": head, "base": F.expr(f"conv_id - conv_id % {self.family}")}), "conversations"
        )
        donor = own.select(F.col("conv_id").alias("base"), F.col("begin").alias("given"))

        def at(entries: str, pos: str) -> list[Column]:
            return [F.expr(f"coalesce(get({entries}, int({pos}) - 1).{s}, 0L)") for s in _SUMS]

        # s: what the head has summed up; o: what the own turns that it replaces have
        plans = (
            own.join(donor, "base", "left")
            .withColumn("m", F.expr("least(h, coalesce(size(given), 0))"))
            .select(
                "conv_id",
                "h",
                "m",
                F.expr("m + greatest(0, n - h)").alias("ends"),
                F.expr("slice(coalesce(given, array()), 1, int(m))").alias("given"),
                F.struct(*[c.alias(s) for c, s in zip(at("given", "m"), _SUMS, strict=True)]).alias("s"),
                F.struct(*[c.alias(s) for c, s in zip(at("begin", "least(h, n)"), _SUMS, strict=True)]).alias("o"),
            )
        )
        plans = write_table(plans, "plans")
        columns = ["conv_id", "ends", "depth", *_MARKS, "ref_conv", "ref_pos", "bytes"]
        roots = plans.select(
            "conv_id", "ends", *[F.lit(0).cast("bigint").alias(c) for c in columns[2:]]
        )
        heads = plans.select("conv_id", "ends", F.inline("given")).withColumnsRenamed(
            {"pos": "depth", **dict(zip(_SUMS, _MARKS, strict=True))}
        )
        rests = (
            prefixes.join(plans.drop("given"), "conv_id")
            .where("pos > h")
            .withColumn("depth", F.expr("m + pos - h"))
            .withColumns({mark: F.expr(self._combined(k, bases[k])) for k, mark in enumerate(_MARKS)})
        )
        every = roots.unionByName(heads.select(*columns)).unionByName(rests.select(*columns))
        above = {
            name: F.expr(
                f"if(depth = 0, -1L, pmod({_MARKS[k]} - {self._number(k, drawn)} * "
                f"{_power(bases[k], PRIMES[k], 'greatest(depth - 1, 0)')} % {PRIMES[k]}, {PRIMES[k]}))"
            )
            for k, name in enumerate(_ABOVE)
        }
        return write_table(every.withColumns(above).withColumn("is_end", F.expr("depth = ends")).drop("ends"), "members")

    def _combined(self, k: int, base: int) -> str:
        """SQL of head times rest: the own sum behind the head is moved from place h to place m, which is no later."""
        prime = PRIMES[k]
        back = ", ".join(f"{pow(base, -j, prime)}L" for j in range(self.heads))
        rest = f"pmod({_SUMS[k]} - o.{_SUMS[k]}, {prime})"
        return f"(s.{_SUMS[k]} + {rest} * element_at(array({back}), int(h - m) + 1)) % {prime}"

    @staticmethod
    def _groups(members: DataFrame) -> DataFrame:
        """Members by depth and fingerprint, and whether their last turns and their parents are the same."""
        checked = ("ref_conv", "ref_pos", *_ABOVE)
        grouped = members.groupBy("depth", *_MARKS).agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.min("bytes").alias("bytes"),
            *[F.min(c).alias(c) for c in checked],
            *[F.max(c).alias(f"most_{c}") for c in checked],
        )
        same = " AND ".join(f"{c} = most_{c}" for c in checked)
        return write_table(
            grouped.withColumn("verified", F.expr(same)).drop("ref_conv", "ref_pos", *[f"most_{c}" for c in checked]),
            "nodes",
        )

    def _trie(self, nodes: DataFrame, members: DataFrame) -> DataFrame:
        of_parent = dict(zip(_ABOVE, _MARKS, strict=True))
        children = (
            nodes.where("depth > 0")
            .groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(h) for p, h in of_parent.items()])
            .agg(F.count(F.lit(1)).alias("n_children"))
        )
        parents = nodes.select(
            (F.col("depth") + 1).alias("depth"),
            *[F.col(h).alias(p) for p, h in of_parent.items()],
            F.col("conv_id").alias("parent_conv_id"),
        )
        tree = write_table(
            nodes.join(parents, ["depth", *_ABOVE], "left")
            .join(children, ["depth", *_MARKS], "left")
            .select(
                "conv_id",
                "depth",
                *_MARKS,
                "parent_conv_id",
                "n_convs",
                F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
                F.expr("bigint(n_children IS NULL)").alias("leaves"),
                F.expr("(n_convs - 1) * bytes").alias("saved"),
            ),
            "tree",
        )
        hanging = self._hanging(tree)
        weighed = tree.join(hanging, ["conv_id", "depth"], "left").withColumns(
            {c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("leaves", "saved")}
        )
        summed = running(
            weighed.drop("more_leaves", "more_saved"),
            [F.col("depth").desc()],
            by=["conv_id"],
            sums={"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")},
        )
        return summed.join(self._ends(members), ["depth", *_MARKS], "left").select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )

    @staticmethod
    def _hanging(tree: DataFrame) -> DataFrame:
        """(conv_id, depth, more_leaves, more_saved): totals of the chains that hang on a node of another chain."""
        # a chain is named by its smallest member, and hangs on the parent of its topmost node
        other = F.when(F.col("parent_conv_id") != F.col("conv_id"), F.col("parent_conv_id"))
        chains = tree.groupBy("conv_id").agg(
            F.max(other).alias("on"), (F.min("depth") - 1).alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        totals = write_table(chains.withColumn("up", F.col("on")), "chains")
        while not totals.where("up IS NOT NULL").isEmpty():
            # up is the chain 2^k above, and the totals cover what hangs less than 2^k below
            gains = totals.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(
                F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
            )
            above = totals.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
            totals = write_table(
                totals.join(above, "up", "left")
                .join(gains, "conv_id", "left")
                .select(
                    "conv_id",
                    "on",
                    "at",
                    *[(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved")],
                    F.col("next").alias("up"),
                ),
                "chains",
            )
        return (
            totals.where("on IS NOT NULL")
            .groupBy(F.col("on").alias("conv_id"), F.col("at").alias("depth"))
            .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        )

    @staticmethod
    def _ends(members: DataFrame) -> DataFrame:
        """(depth, fingerprint, ends_sha256) of the nodes where conversations end.

        Ids are put in order and joined in blocks that may cut a node; only the pieces of a node come together,
        and they pass its hash one after the other, as a hash of a whole list must.
        """
        key = ["depth", *_MARKS]
        kinds = ", ".join(f"{c} bigint" for c in key)
        ends = members.where("is_end").select(*key, "conv_id")
        pieces = (
            ends.repartitionByRange(*key, "conv_id")
            .sortWithinPartitions(*key, "conv_id")
            .mapInArrow(_pieces(len(key)), f"{kinds}, first bigint, ids string")
        )
        return (
            pieces.repartition(*key)
            .sortWithinPartitions(*key, "first")
            .drop("first")
            .mapInArrow(_hashes(len(key)), f"{kinds}, ends_sha256 string")
        )
