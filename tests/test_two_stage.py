import pytest
from pyspark.sql import functions as F

from clickloom.options import BoostingParams, FtrlParams, LearnerOptions
from clickloom.plans.ctr import two_stage

SMALL = BoostingParams(trees=3, depth=3, learning_rate=0.1, bins=32)


@pytest.fixture(scope="module")
def log(spark):
    """Clicks that depend on two categories."""
    noise = F.pmod(F.xxhash64("id"), F.lit(100))
    return spark.range(3000).select(
        "id",
        F.concat(F.lit("s"), F.col("id") % 12).alias("site"),
        F.concat(F.lit("a"), F.col("id") % 7).alias("app"),
        (F.col("id") % 4).cast("int").alias("batch"),
        ((F.col("id") % 12 < 5) & (noise < 80) | (noise < 10)).cast("int").alias("click"),
    )


@pytest.mark.parametrize("fit_on", ["train", "all"])
def test_both_stages_find_the_signal(log, fit_on):
    fitted = two_stage(
        log,
        ["id", "site", "app"],
        "click",
        "id",
        "batch",
        boosting=SMALL,
        ftrl=FtrlParams(l1=0.1),
        options=LearnerOptions(epochs=1),
        fit_on=fit_on,
    )
    report = {r["stage"]: r for r in fitted.report().collect()}
    assert report.keys() == {"boosted_trees", "ftrl_on_leaves"}
    held_out = fitted.tree_scores.where("not is_train").count()
    for r in report.values():
        assert r["rows"] == held_out
        assert r["auc"] > 0.75 and r["accuracy"] > 0.75 and 0 < r["logloss"] < 0.6

    width = sum(fitted.trees.leaf_counts)
    lines = [r["value"].split(",") for r in fitted.leaf_lines(train=False).collect()]
    assert len(lines) == held_out
    assert all(len(f) == width + 1 and f[1:].count("1") == SMALL.trees for f in lines)


def test_fit_on_is_checked(log):
    with pytest.raises(ValueError, match="fit_on"):
        two_stage(log, ["site"], "click", "id", "batch", fit_on="some")
