import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.operators import running


def shuffled(spark, rows, schema):
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_global_running_sum_and_position(spark, blocks):
    rows = [(i, float((i * 37) % 101)) for i in range(500)]
    df = shuffled(spark, rows, "id int, v double")
    got = running.running(df, ["id"], sums={"s": F.col("v")}, number="n", blocks=blocks).toPandas().sort_values("id")
    want = pd.DataFrame(rows, columns=["id", "v"]).sort_values("id")
    assert got["s"].tolist() == want["v"].cumsum().tolist()
    assert got["n"].tolist() == list(range(1, 501))


def test_hot_group_is_split_over_blocks(spark):
    rows = [("hot" if i % 3 else f"g{i % 30}", i, float(i % 7)) for i in range(900)]
    rows += [(None, i, 1.0) for i in range(900, 950)]
    df = shuffled(spark, rows, "g string, id int, v double")
    got = running.running(df, ["v", "id"], by=["g"], sums={"s": F.col("v")}, number="n", blocks=8).toPandas()
    want = pd.DataFrame(rows, columns=["g", "id", "v"]).sort_values(["v", "id"])
    groups = want.groupby("g", dropna=False)
    want["s"], want["n"] = groups["v"].cumsum(), groups.cumcount() + 1
    got, want = got.sort_values("id"), want.sort_values("id")
    assert got["n"].tolist() == want["n"].tolist()
    assert got["s"].tolist() == want["s"].tolist()


def test_rank_by_mixed_keys(spark):
    rows = [(i, i % 4, i % 9) for i in range(200)]
    df = shuffled(spark, rows, "id int, a int, b int")
    got = running.rank_rows(df, [F.desc("a"), F.asc("b"), F.asc("id")], blocks=4).orderBy("position").collect()
    assert [r["id"] for r in got] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]
    assert [r["position"] for r in got] == list(range(200))


def test_average_ranks_over_ties(spark):
    scores = [0.1, 0.1, 0.2, 0.5, 0.5, 0.5, 0.9]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    got = {r["score"]: r["average_rank"] for r in running.average_ranks(df, "score").collect()}
    assert got == {0.1: 1.5, 0.2: 3.0, 0.5: 5.0, 0.9: 7.0}


def test_head_of_each_group_is_sorted_in_place(spark):
    rows = [(g, i, (i * 7) % 11) for g in ("a", "b") for i in range(11)]
    df = shuffled(spark, rows, "g string, pos int, v int")
    got = running.sort_within_groups(df, "g", ["v", "pos"], original="pos", head=5).collect()
    for g in ("a", "b"):
        placed = {r["sorted_position"]: r["v"] for r in got if r["g"] == g}
        original = [(i * 7) % 11 for i in range(11)]
        assert [placed[i] for i in range(11)] == sorted(original[:5]) + original[5:]


def test_empty_input(spark):
    df = spark.range(0).select(F.col("id"), F.lit(1.0).alias("v"))
    assert running.running(df, ["id"], sums={"s": F.col("v")}, number="n").collect() == []


def test_rows_without_a_position_stay(spark):
    df = spark.createDataFrame([("g", 0, 3), ("g", 1, 1), ("g", None, 2)], "g string, original bigint, v int")
    got = running.sort_within_groups(df, "g", ["v"], original="original", head=2).collect()
    assert sorted((r["v"], r["sorted_position"]) for r in got) == [(1, 0), (2, None), (3, 1)]


def test_blocks_follow_the_size_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(running, "BLOCK_BYTES", 20_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    held = []
    for n in (100, 20_000):
        # half of the rows share the first key
        df = spark.range(n).select("id", (F.col("id") % 2 * F.xxhash64("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        staged, blocks = running._staged(df, [F.col("k"), F.col("id")], None)
        counts = {r["_block"]: r["count"] for r in staged.groupBy("_block").count().collect()}
        held.append(len(counts))
        assert max(counts) < blocks and sum(counts.values()) == n
        got = running.running(df, ["k", "id"], number="position").orderBy("k", "id").collect()
        assert [r["position"] for r in got] == list(range(1, n + 1))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert held[0] <= 4 and held[1] > 30
