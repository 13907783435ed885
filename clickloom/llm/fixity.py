"""Merkle fixity audit of web-archive replicas.

A record is hashed with its length. Records in the order of their archive file form runs of ``fanout``, and
each run, an offset range of the file, is a node over the lengths and digests of its children; runs of runs
follow up to one root per file, and runs of files up to one root per replica. An audit compares the roots
and descends into the nodes that differ, so of two replicas that agree almost everywhere almost nothing is
compared. Lengths, not offsets, go into the digests: a record that has grown does not spoil what follows it.
Below the nodes that differ, records are matched by key, which tells a missing or surplus record from the
shifted ones behind it.

All of it is DataFrame operations. A node's children are at most ``fanout``, and a level is a table ``fanout``
times smaller than the one below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.running import running
from clickloom.session import write_table

# records of one archive file, by page id
FILE_RECORDS = 1_024


def warc_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """(file, key, content): a response record per page, ``FILE_RECORDS`` page ids to a file.

    Missing addresses and bodies are empty, pages without id go to file -1.
    """
    body, url = F.coalesce(html, F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    key = F.col("page_id").cast("bigint")
    return pages.select(
        F.coalesce(F.floor(key / FILE_RECORDS).cast("bigint"), F.lit(-1).cast("bigint")).alias("file"),
        key.alias("key"),
        F.concat(head, body, F.lit("\r\n\r\n")).alias("content"),
    )


@dataclass(frozen=True)
class FixityAudit:
    fanout_bits: int = 4

    def records(self, contents: DataFrame) -> DataFrame:
        """(file, seq, key, copy, start, length, digest) of (file, key, content), ordered by key within a file.

        Records with the same key are told apart by ``copy``, their number in the order of their digests.
        """
        hashed = contents.select(
            "file",
            "key",
            F.octet_length("content").cast("bigint").alias("length"),
            F.sha2(F.col("content").cast("binary"), 256).alias("digest"),
        )
        # files of any size and keys of any number: running totals over ranges of records
        placed = running(hashed, ["key", "digest"], by=["file"], sums={"end": F.col("length")}, number="place")
        told = running(placed, ["digest", "place"], by=["file", "key"], number="copy")
        return told.select(
            "file",
            (F.col("place") - 1).alias("seq"),
            "key",
            F.col("copy").cast("int").alias("copy"),
            (F.col("end") - F.col("length")).alias("start"),
            "length",
            "digest",
        )

    def tree(self, records: DataFrame) -> tuple[list[DataFrame], int, int]:
        """Levels of (replica, g, i, length, digest) from the lowest ranges up to a root per replica.

        With them the number of levels within files, and the smallest file number.

        ``i`` numbers the ranges of file ``g``; above the files' roots ``i`` is 0 and ``g`` numbers runs of files.
        """
        bits = self.fanout_bits
        most, low, high = records.agg(F.max("seq"), F.min("file"), F.max("file")).first()
        levels: list[DataFrame] = []
        below = records.select("replica", F.col("file").alias("g"), F.col("seq").alias("i"), "length", "digest")

        def up(g, i, order: str) -> DataFrame:
            child = F.struct(F.col(order).alias("at"), "length", "digest")
            children = F.sort_array(F.collect_list(child))  # at most the fanout
            text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["length"], c["digest"])), ",")
            node = below.groupBy("replica", g.alias("_g"), i.alias("_i")).agg(
                F.sum("length").alias("length"), F.sha2(text, 256).alias("digest")
            )
            node = node.select("replica", F.col("_g").alias("g"), F.col("_i").alias("i"), "length", "digest")
            return write_table(node, "nodes")

        if most is None:
            return levels, 0, 0
        while not levels or most > 0:
            below = up(F.col("g"), F.shiftright("i", bits), "i")
            levels.append(below)
            most >>= bits
        within = len(levels)
        base, last = low, high - low
        while last > 0:
            # files are counted from the smallest one
            g = F.col("g") - (base if len(levels) == within else 0)
            below = up(F.shiftright(g, bits), F.lit(0).cast("bigint"), "g")
            levels.append(below)
            last >>= bits
        return levels, within, base

    def audit(self, expected: DataFrame, found: DataFrame) -> DataFrame:
        """Records that differ between two replicas of (file, key, content).

        One row each: file, key, status (changed, missing or surplus), start and length where the record was
        expected (where it was found, for a surplus one), and the digests. Equal replicas, two empty ones
        among them, give no rows.
        """
        bits = self.fanout_bits
        both = self.records(expected).withColumn("replica", F.lit(0)).union(
            self.records(found).withColumn("replica", F.lit(1))
        )
        both = write_table(both, "records")
        levels, within, base = self.tree(both)
        suspects: DataFrame | None = None
        for depth in range(len(levels) - 1, -1, -1):
            nodes = levels[depth]
            if suspects is not None:
                # parents are a run of files, or a run of ranges of one file
                files = depth + 1 >= within
                g = F.shiftright(F.col("g") - (base if depth + 1 == within else 0), bits) if files else F.col("g")
                i = F.lit(0).cast("bigint") if files else F.shiftright("i", bits)
                nodes = (
                    nodes.withColumn("_g", g).withColumn("_i", i)
                    .join(suspects.select(F.col("g").alias("_g"), F.col("i").alias("_i")), ["_g", "_i"], "left_semi")
                    .select("replica", "g", "i", "length", "digest")
                )
            suspects = write_table(_differing(nodes, ["g", "i"]).select("g", "i"), "suspects")
            if suspects.isEmpty():
                break
        if suspects is None:
            suspects = both.select(F.col("file").alias("g"), F.col("seq").alias("i")).limit(0)
        range_of = both.withColumn("i", F.shiftright("seq", bits)).join(
            suspects.withColumnRenamed("g", "file"), ["file", "i"], "left_semi"
        )
        placed = range_of.withColumn("at", F.struct("start", "length"))
        differing = _differing(placed, ["file", "key", "copy"], ["at"])
        return differing.select(
            "file",
            "key",
            F.when(F.col("expected").isNull(), "surplus").when(F.col("found").isNull(), "missing").otherwise("changed").alias("status"),
            F.coalesce("at_0", "at_1")["start"].alias("start"),
            F.coalesce("at_0", "at_1")["length"].alias("length"),
            F.col("expected").alias("expected_digest"),
            F.col("found").alias("found_digest"),
        )


def _differing(rows: DataFrame, key: list[str], more: list[str] = ()) -> DataFrame:
    """One row per key whose digest is not the same in both replicas."""

    def side(replica: int, column: str):
        return F.max(F.when(F.col("replica") == replica, F.col(column)))

    sides = rows.groupBy(*key).agg(
        side(0, "digest").alias("expected"),
        side(1, "digest").alias("found"),
        *[side(r, c).alias(f"{c}_{r}") for c in more for r in (0, 1)],
    )
    return sides.where(~F.col("expected").eqNullSafe(F.col("found")))
