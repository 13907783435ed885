"""Text files as records in file order, read in byte ranges even where quoted fields hold line breaks.

A line begins a record if the quotes before it in its file are even in number. So quotes are counted per block
(the part of a file that one split reads), what came before a block is carried over as a parity, and each block
then puts its lines together to records by itself. Only a record that is open at the end of a block needs more:
its pieces, one per block that it reaches into, are brought together by key.

Every record carries its place: file, block, and number among the records that begin in the block. That order
is the files' own, whatever the ids in the records, and ``numbered`` turns it into row numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.session import write_table

PLACE = ["_file", "_block", "_place"]

# what a piece is: a whole record, one that goes on in later blocks, the last part of one, a part in the middle
_WHOLE, _OPEN, _LAST, _MIDDLE = range(4)

_PIECES = "_file string, _block bigint, _place bigint, record string, part int"


class _Assembler:
    """Lines of one block after the other to pieces of records."""

    def __init__(self) -> None:
        self.block: tuple[str, int] | None = None
        self.held: list[str] = []
        self.out: list[pa.RecordBatch] = []

    def begin(self, block: tuple[str, int], odd: bool) -> None:
        self.close()
        self.block, self.odd = block, odd
        # number of the next record, number of the one that is open, and whether that began in an earlier block
        self.next, self.at, self.carried = 0, -1, odd

    def close(self) -> None:
        if self.held:
            self._emit([self.at], pa.array(["\n".join(self.held)]), _MIDDLE if self.carried else _OPEN)
            self.held = []

    def _emit(self, places: object, records: pa.Array, part: int) -> None:
        n = len(records)
        columns = [
            pa.array([self.block[0]], pa.string()).take(pa.array(np.zeros(n, np.int32))),
            pa.array(np.full(n, self.block[1], np.int64)),
            pa.array(places, pa.int64()),
            records,
            pa.array(np.full(n, part, np.int32)),
        ]
        self.out.append(pa.RecordBatch.from_arrays(columns, [*PLACE, "record", "part"]))

    def lines(self, values: pa.Array) -> None:
        """The next lines of the block."""
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
        after = (np.cumsum(odd) + self.odd) & 1
        starts = np.flatnonzero(np.concatenate([[int(self.odd)], after[:-1]]) == 0)
        ends = np.flatnonzero(after == 0)
        if self.odd:
            # the record that is open, up to its end or that of the lines
            last = int(ends[0]) + 1 if len(ends) else len(values)
            self.held += values.slice(0, last).to_pylist()
            if len(ends):
                self._emit([self.at], pa.array(["\n".join(self.held).removesuffix("\r")]), _LAST if self.carried else _WHOLE)
                self.held, self.at, self.carried = [], -1, False
            ends = ends[1:]
        if len(ends):
            # all lines between the first start and the last end are records that begin and end here
            within = values.slice(int(starts[0]), int(ends[-1] + 1 - starts[0]))
            bounds = np.append(starts[: len(ends)], ends[-1] + 1) - starts[0]
            records = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), within), "\n")
            records = pc.replace_substring_regex(records, "\r$", "")
            records = records.filter(pc.not_equal(pc.utf8_trim_whitespace(records), ""))
            if len(records):
                self._emit(self.next + np.arange(len(records)), records, _WHOLE)
            self.next += len(records)
        if len(starts) > len(ends):
            self.at = self.next
            self.held = values.slice(int(starts[-1])).to_pylist()
            self.next += 1
        self.odd = bool(after[-1])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_file, _block, odd, value) of lines in order to pieces of records."""
    assembler = _Assembler()
    for batch in batches:
        values = batch.column(3)
        blocks = pc.run_end_encode(batch.column(1))
        files = pc.run_end_encode(batch.column(0))
        edges = np.unique(np.concatenate([[0], files.run_ends.to_numpy(), blocks.run_ends.to_numpy()]))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            block = batch.column(0)[start].as_py(), batch.column(1)[start].as_py()
            if block != assembler.block:
                assembler.begin(block, batch.column(2)[start].as_py())
            assembler.lines(values.slice(start, end - start))
        yield from assembler.out
        assembler.out = []
    assembler.close()
    yield from assembler.out


def read_lines_in_place(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """(_file, _block, _place, value) of all lines; the place grows along a block, with gaps between blocks only."""
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        # a split is read from its start to its end by one task
        F.monotonically_increasing_id().alias("_place"),
        "value",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _place, record) of all records of files with quoted fields, headers included.

    Records end at line feeds, with or without a carriage return, outside of quotes. Blank records are left out.
    A quote that is never closed is an error, and so, as the format says, quotes only stand in quoted fields.
    """
    lines = read_lines_in_place(spark, path, "\n").drop("_place")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # a row per split of the files, and of these only those that begin inside a field are kept
    split_inside = write_table(
        lines.groupBy("_file", "_block")
        .agg(F.sum(quotes).alias("quotes"))
        .select("_file", "_block", (F.pmod(F.coalesce(F.sum("quotes").over(earlier), F.lit(0)), F.lit(2)) == 1).alias("odd"), "quotes")
        .where("odd OR pmod(quotes, 2) = 1"),
        "splits",
    )
    carried = F.broadcast(split_inside.select("_file", "_block", "odd"))
    placed = lines.join(carried, ["_file", "_block"], "left").select(
        "_file", "_block", F.coalesce("odd", F.lit(False)).alias("odd"), "value"
    )
    whole = placed.mapInArrow(_pieces, _PIECES).where(F.col("part") == _WHOLE).drop("part")
    if split_inside.isEmpty():
        return whole
    # only blocks that begin or end inside a field hold pieces, so only these are put together again
    reaching = lines.join(carried, ["_file", "_block"]).select("_file", "_block", "odd", "value")
    return whole.unionByName(_joined(reaching.mapInArrow(_pieces, _PIECES).where(F.col("part") != _WHOLE)))


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that reach over blocks, each at the place where it begins; at most two pieces come from a block."""
    along = Window.partitionBy("_file").orderBy("_block", F.col("part") == _OPEN)
    begun = pieces.withColumn("record_no", F.sum((F.col("part") == _OPEN).cast("int")).over(along))
    piece = F.struct("_block", (F.col("part") == _OPEN).alias("opens"), "record", "_place")
    records = begun.groupBy("_file", "record_no").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"), F.max((F.col("part") == _LAST).cast("int")).alias("closed")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["record"]), "\n")
    unclosed = F.raise_error(F.concat(F.lit("a quote is not closed in "), "_file")).cast("string")
    first = F.get("pieces", F.lit(0))
    return records.select(
        "_file", first["_block"].alias("_block"), first["_place"].alias("_place"),
        F.when(F.col("closed") == 1, text).otherwise(unclosed).alias("record"),
    )


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Replace the place of the written ``rows`` by their number in file order, from 0; files follow by name."""
    blocks = rows.groupBy("_file", "_block").agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("held"))
    # a row per split of the files
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = write_table(
        blocks.select("_file", "_block", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift")),
        "file-blocks",
    )
    others = [c for c in rows.columns if c not in PLACE]
    return rows.join(F.broadcast(starts), ["_file", "_block"]).select(
        *others, (F.col("_place") + F.col("shift")).cast("bigint").alias(name)
    )
