import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from clickloom.functions.hashing import slot_number
from clickloom.operators.trees import BoostedTrees, Ensemble, Leaf, Split, leaf_cells, leaf_line, leaf_slots
from clickloom.operators.vectorize import vectorize_positional
from clickloom.options import BoostingParams, ColumnRoles

TREES = Ensemble(
    (
        Split("a", Leaf(1.0), Leaf(-1.0), threshold=0.5),
        Split("b", Split("a", Leaf(0.1), Leaf(0.2), threshold=2.0), Leaf(0.3), categories=(1.0, 4.0)),
    ),
    (1.0, 0.5),
)


def points(spark, rows):
    return spark.createDataFrame(rows, "a double, b double")


def test_threshold_goes_left_and_categories_are_sets(spark):
    df = points(spark, [(0.5, 1.0), (0.6, 4.0), (3.0, 1.0), (0.0, 2.0)])
    got = [tuple(r[0]) for r in df.select(TREES.leaf_positions()).collect()]
    assert got == [(0, 0), (1, 0), (1, 1), (0, 2)]


def test_score_is_the_weighted_sum(spark):
    r = TREES.score(points(spark, [(3.0, 1.0)])).first()
    assert r["raw_score"] == pytest.approx(-1.0 + 0.5 * 0.2)
    assert r["prediction"] == 0.0


def test_leaf_line_and_slots(spark):
    df = points(spark, [(3.0, 2.0)]).withColumn("y", F.lit(0.0))
    positions = TREES.leaf_positions()
    assert TREES.leaf_counts == [2, 3]
    got = df.select(
        leaf_line(F.col("y"), positions, [2, 3]).alias("line"), leaf_slots(positions, [2, 3]).alias("slots")
    ).first()
    assert got["line"] == "0,0,1,0,0,1"
    assert got["slots"] == [1, 4]


def test_leaf_cells_equal_the_text_detour(spark):
    df = points(spark, [(0.1, 1.0), (3.0, 1.0), (3.0, 2.0)]).withColumn("id", F.monotonically_increasing_id())
    positions = TREES.leaf_positions()
    direct = df.select("id", leaf_cells(leaf_slots(positions, [2, 3]), [2, 3], 4_000_000).alias("f"))
    roles = ColumnRoles("0", "id", (), ("1", "2", "3", "4", "5"))
    lines = df.select("id", F.split(leaf_line(F.lit(1), positions, [2, 3]), ",").alias("fields"))
    detour = vectorize_positional(lines, "fields", roles)
    want = {r["row_id"]: set(map(tuple, r["features"])) for r in detour.collect()}
    assert {r["id"]: set(map(tuple, r["f"])) for r in direct.collect()} == want
    assert any((slot_number("1_1", 4_000_000), 1.0) in f for f in want.values())


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(600).select(
        "id",
        (F.col("id") % 17).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") % 17 > 8) != (F.col("id") % 5 == 0)).cast("int").alias("y"),
    )
    trees = BoostedTrees.fit(df, ["a", "b"], "y", BoostingParams(trees=3, depth=3, learning_rate=0.1, bins=32))
    return df, trees


def test_boosting_learns_a_planted_signal(fitted):
    df, trees = fitted
    scored = trees.transform(df)
    assert scored.where("y <> prediction").count() == 0
    assert "features" not in scored.columns


def test_boosting_probability_identity(fitted):
    df, trees = fitted
    gap = F.max(F.abs(F.col("probability") - 1 / (1 + F.exp(-2 * F.col("raw_score")))))
    assert trees.transform(df).agg(gap).first()[0] < 1e-12


def test_one_leaf_per_tree_and_row(fitted):
    df, trees = fitted
    counts = trees.leaf_counts
    for r in trees.transform(df).select("leaf_positions").distinct().collect():
        assert len(r[0]) == 3
        assert all(0 <= p < n for p, n in zip(r[0], counts, strict=True))


def test_exported_trees_route_and_score_alike(fitted):
    df, trees = fitted
    exported = trees.ensemble()
    assert exported.leaf_counts == trees.leaf_counts
    both = trees.transform(df).withColumn("p", exported.leaf_positions()).withColumn("f", exported.raw())
    assert both.where("p <> leaf_positions").count() == 0
    assert both.agg(F.max(F.abs(F.col("f") - F.col("raw_score")))).first()[0] < 1e-12


def test_training_rows_of_one_partition_are_spread(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()))
    for rows in (100_000, 600):
        log = spark.range(0, rows, 1, 1).selectExpr("id % 2 AS y", "double(id) AS a", "double(id % 7) AS b")
        BoostedTrees.fit(log, ["a", "b", "a"], "y")
    assert seen == [min(spark.sparkContext.defaultParallelism, 2), 1]
