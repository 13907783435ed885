import pytest
from pyspark.sql import functions as F

from clickloom.operators import encode, lookup, splits
from clickloom.operators.counts import CountEncoder, count_stats, explode_features


def test_support_threshold_and_shares(spark):
    rows = [("a", 1 if i < 4 else 0) for i in range(10)] + [("b", 1)] * 9
    df = spark.createDataFrame(rows, "c string, y int")
    got = [tuple(r) for r in count_stats(df, ["c"], "y").collect()]
    assert got == [("c", "a", 4, 10, 0.4, 0.6)]


def test_missing_value_is_a_category(spark):
    df = spark.createDataFrame([(None, 1)] * 12, "c string, y int")
    assert count_stats(df, ["c"], "y").first()["value"] == ""


def test_columns_do_not_share_values(spark):
    df = spark.createDataFrame([("x", "x", 1)] * 10 + [("x", "z", 0)] * 10, "c string, d string, y int")
    got = {(r["feature"], r["value"]): r["p1"] for r in count_stats(df, ["c", "d"], "y").collect()}
    assert got == {("c", "x"): 0.5, ("d", "x"): 1.0, ("d", "z"): 0.0}


def test_explode_keeps_every_cell(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, "b", "c", 0)], "id int, c string, d string, y int")
    assert explode_features(df, ["id", "c"], "y", ["id"]).count() == 4
    got = sorted(tuple(r) for r in explode_features(df, ["c", "d"], "y", ["id"]).collect())
    assert got == [(1, 1.0, "c", "a"), (1, 1.0, "d", ""), (2, 0.0, "c", "b"), (2, 0.0, "d", "c")]


@pytest.fixture
def log(spark):
    # one value holds a third of all rows, many are rare
    rows = [(i, "hot" if i % 3 == 0 else f"v{i % 50}", str(i % 7), f"id{i}", i % 2) for i in range(1500)]
    return spark.createDataFrame(rows, "id int, a string, b string, u string, y int")


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 20, 0])
def test_encoding_is_the_same_on_every_join_path(spark, log, broadcast_rows, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.1)
    encoder = CountEncoder.fit(log, ["u", "a", "b"], "y")
    got = {r["id"]: r for r in encoder.transform(log, broadcast_rows).collect()}
    assert len(got) == 1500
    counts = {}
    for r in log.collect():
        for c in ("a", "b"):
            n, s = counts.get((c, r[c]), (0, 0))
            counts[c, r[c]] = n + 1, s + r["y"]
    for r in log.collect():
        for c in ("a", "b"):
            n, s = counts[c, r[c]]
            want = (s / n, (n - s) / n) if n >= 10 else (0.0, 0.0)
            assert (got[r["id"]][f"{c}_p1"], got[r["id"]][f"{c}_p0"]) == want
        assert got[r["id"]]["u_p1"] == got[r["id"]]["u_p0"] == 0.0


def test_small_dictionaries_are_applied_without_a_shuffle(spark, log, plan_of):
    encoder = CountEncoder.fit(log, ["a", "b"], "y")
    plan = plan_of(encoder.transform(log))
    assert plan.count("BroadcastHashJoin") == 2
    assert "Exchange hashpartitioning" not in plan


def test_many_columns_keep_their_slots(spark):
    names = [f"c{i}" for i in range(23)]
    df = spark.createDataFrame([(r, r % 2, *[f"{r % (i + 2)}" for i in range(23)]) for r in range(400)], ["id", "y", *names])
    encoder = CountEncoder.fit(df, names, "y")
    assert len(encoder.slots) == 46
    stats = {(r["feature"], r["value"]): r["p1"] for r in encoder.stats.table.collect()}
    for r in encoder.transform(df).collect():
        for c in names:
            assert r[f"{c}_p1"] == stats.get((c, r[c]), 0.0)


def test_sizes_count_long_texts(spark):
    df = spark.createDataFrame([("x" * 6000,)] * 3, "c string")
    dictionary = encode.Dictionary.write(encode.value_counts(df, ["c"]), "t")
    assert dictionary.sizes == {"c": 101}
    assert dictionary.rows == 3


def test_hash_split_is_stable_and_disjoint(spark):
    df = spark.range(2000)
    train, test = splits.hash_split(df, "id")
    again, _ = splits.hash_split(df.repartition(7), "id")
    ids = {r[0] for r in train.collect()}
    assert ids == {r[0] for r in again.collect()}
    assert ids.isdisjoint({r[0] for r in test.collect()})
    assert train.count() + test.count() == 2000
    assert 1300 < len(ids) < 1500


def test_negative_sampling_keeps_positives_and_reweights(spark):
    df = spark.range(4000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    got = splits.sample_negatives(df, "y", "id", keep_percent=25)
    assert got.where("y = 1").count() == 400
    kept = got.where("y = 0")
    assert kept.select("weight").distinct().collect() == [(4.0,)]
    assert 3200 < kept.agg(F.sum("weight")).first()[0] < 4000


def test_line_filter_and_mismatches(spark):
    lines = spark.createDataFrame([("id,click",), ("7,1",)], "value string")
    assert splits.without_text(lines, "id").collect() == [("7,1",)]
    df = spark.createDataFrame([(1, 1), (1, 0)], "y int, c int")
    assert splits.mismatches(df, "y", "c").collect() == [(1, 0)]
