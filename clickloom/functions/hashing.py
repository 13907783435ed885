"""Hash expressions: the 31-polynomial string hash, hashed feature slots, stable hash buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 4294967296  # 2^32
_MASK = _WORD - 1


def _utf16_units(text: str) -> list[int]:
    raw = text.encode("utf-16-be")
    return [raw[i] * 256 + raw[i + 1] for i in range(0, len(raw), 2)]


def prefix_state(text: str) -> int:
    """Hash state, in [0, 2^32), after the given constant text."""
    state = 0
    for unit in _utf16_units(text):
        state = (state * 31 + unit) % _WORD
    return state


def slot_number(text: str, max_features: int) -> int:
    """Feature slot of a constant text, without any offset."""
    state = prefix_state(text)
    return abs(state - _WORD if state >= _WORD // 2 else state) % max_features


def _fed(state: Column | int, text: Column, finish: Callable[[Column], Column]) -> Column:
    """Feed the characters of ``text`` into a hash state, then apply ``finish`` to the state.

    The hash is defined over UTF-16 units, so a character beyond U+FFFF counts as its two surrogates.
    ``finish`` runs inside the aggregate, so that the state is computed once however often it is used.
    """

    def feed(acc: Column, code: Column) -> Column:
        high = 55296 + F.shiftright(code - 65536, 10)
        low = 56320 + (code - 65536).bitwiseAND(1023)
        return F.when(code < 65536, (acc * 31 + code).bitwiseAND(_MASK)).otherwise(
            ((acc * 31 + high) * 31 + low).bitwiseAND(_MASK)
        )

    # splitting the empty text gives one empty piece, which the slice drops
    chars = F.slice(F.split(text, ""), F.lit(1), F.length(text))
    codes = F.transform(chars, lambda char: F.ascii(char).cast("bigint"))
    start = F.lit(state).cast("bigint") if isinstance(state, int) else state
    return F.aggregate(codes, start, feed, finish)


def _signed32(state: Column) -> Column:
    """Read a hash state as a signed 32-bit number (kept in a bigint)."""
    half = _WORD // 2
    return (state + half).bitwiseAND(_MASK) - half


def string_hash(text: Column) -> Column:
    """Signed 32-bit polynomial hash of a string, h = 31 h + unit."""
    return _fed(0, text, _signed32)


def slot_after(state: Column | int, text: Column, max_features: int, offset: int = 0) -> Column:
    """Feature slot, offset + |hash| mod max_features, of a constant prefix's state and a text behind it."""
    return _fed(state, text, lambda s: F.abs(_signed32(s)) % max_features + offset).cast("int")


def hashed_slot(name: str, value: Column, max_features: int, offset: int = 0) -> Column:
    """Feature slot of category ``value`` of column ``name``; the hashed text is ``name_value``.

    The constant part is hashed once in Python; only the characters of the value are read per row.
    """
    return slot_after(prefix_state(name + "_"), value, max_features, offset)


def hash_percent(key: Column) -> Column:
    """Stable bucket 0..99 of a key; a missing key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
