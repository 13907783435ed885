import math
import random

import pytest
from pyspark.sql import functions as F

from clickloom.functions import hashing, scalar


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_sigmoid_is_clipped(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (-100.0,)], "v double")
    sig = [1 / (1 + math.exp(-m)) for m in (0, 35, -35)]
    assert values(df, scalar.sigmoid(F.col("v"))) == pytest.approx(sig, rel=1e-14)


def test_sign_of_zero_is_plus(spark):
    df = spark.createDataFrame([(0.0,), (-0.1,), (3.0,)], "v double")
    assert values(df, scalar.sign_plus(F.col("v"))) == [1, -1, 1]


def test_log_loss_stays_finite(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 0), (0.5, 1), (0.5, 0)], "p double, y int")
    got = values(df, scalar.log_loss(F.col("p"), F.col("y")))
    want = [-math.log(1e-14), -math.log(1 - (1 - 1e-14)), math.log(2), math.log(2)]
    assert got == pytest.approx(want, rel=1e-9)


def test_boosting_probability(spark):
    df = spark.createDataFrame([(0.0,), (0.5,)], "f double")
    assert values(df, scalar.boosting_probability(F.col("f"))) == pytest.approx([0.5, 1 / (1 + math.exp(-1))])


def polynomial_hash(text):
    h = 0
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (31 * h + unit) % 2**32
    return h - 2**32 if h >= 2**31 else h


def test_string_hash(spark):
    # fixed values: hashes that the formula must give
    known = {"hello": 99162322, "C14_15706": 330202112, "device_model_8a4875bd": -834008596}
    texts = [*known, "", "é中文", "a😀b", "𝄞", "x" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = dict(df.select("s", hashing.string_hash(F.col("s"))).collect())
    assert {t: got[t] for t in known} == known
    assert got == {t: polynomial_hash(t) for t in texts}


def test_string_hash_over_all_planes(spark):
    rng = random.Random(13)
    ranges = [(0, 0x80), (0x80, 0x800), (0x800, 0xD800), (0xE000, 0x10000), (0x10000, 0x110000)]
    texts = sorted({"".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(12))) for _ in range(400)})
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = dict(df.select("i", hashing.string_hash(F.col("s"))).collect())
    assert [got[i] for i in range(len(texts))] == [polynomial_hash(t) for t in texts]


def test_hashed_slot(spark):
    # fixed values: slots among 4,000,000
    known = {("C14", "15706"): 2202112, ("device_model", "8a4875bd"): 2008596, ("1", "1"): 50083, ("30", "1"): 1568463}
    for (name, value), slot in known.items():
        df = spark.createDataFrame([(value,)], "v string")
        assert values(df, hashing.hashed_slot(name, F.col("v"), 4_000_000)) == [slot]
        assert values(df, hashing.hashed_slot(name, F.col("v"), 4_000_000, 7)) == [slot + 7]
        assert hashing.slot_number(f"{name}_{value}", 4_000_000) == slot


def test_empty_value_adds_nothing_to_the_prefix(spark):
    df = spark.createDataFrame([("",), ("\0",)], "v string")
    got = values(df, hashing.hashed_slot("b", F.col("v"), 4_000_000))
    assert got == [hashing.slot_number("b_", 4_000_000), hashing.slot_number("b_\0", 4_000_000)]


def test_most_negative_hash_gives_a_slot_in_range(spark):
    text = "polygenelubricants"  # hashes to -2^31
    assert polynomial_hash(text) == -(2**31)
    df = spark.createDataFrame([(text,)], "v string")
    slot = values(df, hashing.slot_after(0, F.col("v"), 1000))[0]
    assert slot == 2**31 % 1000


def test_leaf_keys_do_not_collide():
    assert len({hashing.slot_number(f"{k}_1", 4_000_000) for k in range(1, 3600)}) == 3599
