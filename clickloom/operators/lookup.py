"""Left-outer lookup join that stays safe when the lookup table is large and a key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import BROADCAST_ROWS, write_table

# A key is hot when it holds at least this share of all occurrences. Shares add up to one, so there can
# be at most 1 / HOT_SHARE hot keys, which bounds the broadcast of the hot part.
HOT_SHARE = 1e-4

# the filter over cold keys: bits of a bitmap, bitmaps at most (32 MB), bits for each key, and bits set by one
_BITMAP_BITS = 32_768
_BITMAPS = 8_192
_BITS_PER_KEY = 12
_PROBES = 4


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    fact_key: str,
    lookup_key: str,
    values: dict[str, Column],
    *,
    lookup_rows: int,
    occurrences: str | None = None,
    total: int = 0,
    limit: int = BROADCAST_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Left-join ``lookup`` to ``facts`` and add one column per entry of ``values``.

    ``values`` maps the new column names to expressions over the lookup columns; they are NULL where
    the key is missing. ``lookup_rows`` is the measured size of the lookup.

    Up to ``limit`` rows the lookup is broadcast and the facts do not move. Beyond that the keys whose
    ``occurrences`` reach HOT_SHARE of ``total`` (at most 1 / HOT_SHARE keys) are broadcast, and so is a
    filter over the other, cold keys. Only facts that the hot part has not answered and whose key passes the
    filter are joined by shuffle; as their keys are cold, no task receives many of one. All others, facts of
    no known key among them, stay where they are. Facts are read twice for that: they are written first,
    unless they are ``stored`` already, that is, made by narrow steps from a written table.
    """
    slim = lookup.select(
        F.col(lookup_key).cast(facts.schema[fact_key].dataType).alias("_lk"),
        *[expr.alias(name) for name, expr in values.items()],
        *([F.col(occurrences).alias("_seen")] if occurrences else []),
    )
    if lookup_rows <= limit:
        side = F.broadcast(slim.select("_lk", *values))
        return facts.join(side, facts[fact_key] == side["_lk"], "left").drop("_lk")
    if occurrences is None:
        raise ValueError("a lookup beyond the broadcast limit needs its occurrence counts")

    settled, open_, tail = parts(facts, slim, fact_key, values, lookup_rows, total, stored)
    joined = open_.join(tail, open_[fact_key] == tail["_lk"], "left").withColumn("_found", F.col("_cold"))
    either = settled.withColumn("_found", F.col("_hot"))
    out = [*facts.columns, *[F.col("_found").getField(name).alias(name) for name in values]]
    return either.select(*out).unionByName(joined.select(*out))


def parts(
    facts: DataFrame,
    slim: DataFrame,
    fact_key: str,
    values: dict[str, Column],
    lookup_rows: int,
    total: int,
    stored: bool,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts that need no shuffle, with ``_hot`` where answered; facts that do; cold part of the lookup)."""
    is_hot = F.col("_seen") >= F.lit(HOT_SHARE * total)
    hot = F.broadcast(slim.where(is_hot).select("_lk", F.struct(*values).alias("_hot")))
    tail = slim.where(~is_hot).select("_lk", F.struct(*values).alias("_cold"))
    bitmaps = min(_BITMAPS, -(-lookup_rows * _BITS_PER_KEY // _BITMAP_BITS))
    sketch = F.broadcast(write_table(_filter(tail, bitmaps), "cold-keys"))

    key = F.col(fact_key)
    answered = facts.join(hot, facts[fact_key] == hot["_lk"], "left").drop("_lk")
    near = answered.join(sketch, _bitmap(key, bitmaps) == sketch["_bitmap"], "left")
    passes = F.lit(True)
    for bit in _bits(key):
        octet = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        power = F.element_at(F.lit([1, 2, 4, 8, 16, 32, 64, 128]), (bit % 8 + 1).cast("int"))
        passes = passes & (octet.bitwiseAND(power) != 0)
    cold = F.col("_hot").isNull() & key.isNotNull() & F.coalesce(passes, F.lit(False))
    flagged = near.withColumn("_cold_key", cold).drop("_bitmap", "_bits")
    if not stored:
        flagged = write_table(flagged, "answered")
    return flagged.where("NOT _cold_key").drop("_cold_key"), flagged.where("_cold_key").drop("_cold_key", "_hot"), tail


def _bitmap(key: Column, bitmaps: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bitmaps)).cast("int")


def _bits(key: Column) -> list[Column]:
    """Bits of its bitmap that a key sets."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(_BITMAP_BITS)) for k in range(_PROBES)]


def _filter(keys: DataFrame, bitmaps: int) -> DataFrame:
    """(_bitmap, _bits): a Bloom filter in bitmaps, each key setting bits of one of them."""
    key = F.col("_lk")
    set_ = keys.select(_bitmap(key, bitmaps).alias("_bitmap"), F.explode(F.array(*_bits(key))).alias("_bit"))
    return set_.groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
