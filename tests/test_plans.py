"""Plan shapes that have to hold at scale."""

import re

from clickloom.operators import counts, ftrl
from clickloom.plans.queries import HASHED, PLAIN, event_rows
from clickloom.sources.tables import returned_items

SF_DIR = "/root/testdata/sf0.001"


def exchanges(plan):
    return re.findall(r"Exchange (\w+)", plan.replace("BroadcastExchange", "Broadcast"))


def test_count_stats_is_one_pruned_scan_and_one_shuffle(spark, plan_of):
    plan = plan_of(counts.count_stats(returned_items(spark, SF_DIR), ["l_suppkey", "l_tax"], "returned"))
    assert exchanges(plan) == ["hashpartitioning"]
    assert plan.count("FileScan") == 1
    assert "partial_sum" in plan and "partial_count" in plan
    assert "l_extendedprice" not in plan and "l_partkey" not in plan


def test_row_local_operators_do_not_shuffle(spark, plan_of):
    for name in ("csv_lines_parse", "explode_features", "hash_split", "hash_index", "hash_vector_positional"):
        assert exchanges(plan_of(PLAIN[name](spark, SF_DIR))) == [], name
    for name in ("tree_route", "tree_ensemble_score", "leaf_onehot", "leaf_file_rows", "negative_sampling"):
        assert exchanges(plan_of(PLAIN[name](spark, SF_DIR))) == [], name


def test_scoring_shuffles_one_number_per_row(spark, plan_of):
    plan = plan_of(HASHED.score(event_rows(spark, SF_DIR), ftrl.empty_state(spark)))
    assert exchanges(plan) == ["hashpartitioning"]
    shuffled = plan[plan.index("Exchange hashpartitioning") :]
    assert shuffled.splitlines()[1].strip().startswith("+- HashAggregate")


def test_global_ranks_never_sort_all_rows_in_one_task(spark, plan_of):
    plan = plan_of(PLAIN["rank_rows"](spark, SF_DIR))
    rows, carries = plan.split("Broadcast", 1)
    assert "SinglePartition" not in rows
