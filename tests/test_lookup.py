import pytest
from pyspark.sql import functions as F

from clickloom.operators import lookup


@pytest.fixture
def tables(spark):
    """Half of the facts have one key, some a cold one, many none that the lookup knows, some none at all."""
    facts = spark.range(8_000).select(
        "id",
        F.when(F.col("id") % 2 == 0, "hot")
        .when(F.col("id") % 7 == 0, F.concat(F.lit("cold"), F.col("id") % 500))
        .when(F.col("id") % 11 == 0, None)
        .otherwise(F.concat(F.lit("unknown"), "id"))
        .alias("key"),
    )
    known = [("hot", 1.0, 4_000), (None, 9.0, 1)] + [(f"cold{k}", float(k), 2) for k in range(500)]
    return facts, spark.createDataFrame(known, "k string, w double, seen bigint")


def joined(facts, table, limit, stored=False):
    out = lookup.lookup_join(
        facts, table, "key", "k", {"w": F.col("w")}, lookup_rows=502, occurrences="seen", total=5_000, limit=limit, stored=stored
    )
    assert out.columns == ["id", "key", "w"]
    return {r["id"]: r["w"] for r in out.collect()}


@pytest.mark.parametrize("bitmaps", [1, 8_192])
def test_both_ways_give_the_same_rows(tables, monkeypatch, bitmaps):
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.1)
    monkeypatch.setattr(lookup, "_BITMAPS", bitmaps)
    facts, table = tables
    want = joined(facts, table, 1_000)
    assert len(want) == 8_000 and sum(w is not None for w in want.values()) > 4_000
    for stored in (False, True):
        assert joined(facts, table, 0, stored) == want


def test_only_rows_of_cold_keys_are_shuffled(tables, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.1)
    facts, table = tables
    slim = table.select(F.col("k").alias("_lk"), "w", F.col("seen").alias("_seen"))
    settled, open_, tail = lookup.parts(facts, slim, "key", {"w": F.col("w")}, 502, 5_000, True)
    cold = facts.where("key LIKE 'cold%'").count()
    assert settled.count() + open_.count() == 8_000
    assert open_.where("key LIKE 'cold%'").count() == cold and open_.count() < 1.1 * cold
    assert settled.where("_hot IS NOT NULL").count() == 4_000


def test_facts_pass_one_shuffle_behind_the_filter(tables, plan_of, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.1)
    facts, table = tables
    plan = plan_of(
        lookup.lookup_join(
            facts, table, "key", "k", {"w": F.col("w")}, lookup_rows=502, occurrences="seen", total=5_000, limit=0, stored=True
        )
    )
    plain, shuffled = plan.split("SortMergeJoin")[0], plan.split("SortMergeJoin")[1:]
    assert "Union" in plain and "Exchange hashpartitioning" not in plain and len(shuffled) == 1


def test_keys_of_other_types(spark):
    facts = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, key int")
    table = spark.createDataFrame([(5, 0.5, 1), (7, 0.7, 1)], "k bigint, w double, seen bigint")
    assert joined(facts, table, 0) == {1: 0.5, 2: None, 3: None}
    assert joined(facts, table.limit(0), 0) == {1: None, 2: None, 3: None}
