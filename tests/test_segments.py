import contextlib
import math
import random

import pytest

from clickloom.operators.segments import RecordLoss, fit_by_segment, progress_by_segment
from clickloom.options import FtrlParams

ROWS = "segment bigint, number int, y double, features array<struct<idx:int,x:double>>"


@contextlib.contextmanager
def batches_of(spark, rows):
    """Arrow batches of at most so many rows: a segment's stream then comes in several."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    yield
    spark.conf.set(key, before)


def test_rows_without_a_segment_are_one(spark):
    rows = [(s, i, float(i % 2), [(1, 1.0)]) for s in (5, None) for i in range(6)]
    df = spark.createDataFrame(rows, ROWS)
    for size in ("2", "100"):
        with batches_of(spark, size):
            got = {r["segment"]: (r["idx"], r["z"], r["n"]) for r in fit_by_segment(df, "segment", "number").collect()}
        assert got.keys() == {5, None} and got[5] == got[None]


def test_the_plan_has_one_shuffle_and_one_sort(spark, plan_of):
    df = spark.createDataFrame([(1, 1, 1.0, [(1, 1.0)])], ROWS)
    plan = plan_of(fit_by_segment(df, "segment", "number"))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


@pytest.mark.parametrize("size", ["3", "1000"])
def test_log_of_every_record(spark, size):
    rng = random.Random(8)
    rows = [(s, k * 7 % 50, float(rng.random() < 0.4), [(i, 1.0) for i in rng.sample(range(6), 3)]) for s in (1, None) for k in range(50)]
    weights = {(r[0], r[1]): rng.choice([1.0, 4.0]) for r in rows}
    df = spark.createDataFrame([(*r, weights[r[:2]]) for r in rows], f"{ROWS}, weight double").repartition(5)
    params = FtrlParams(l1=0.1, alpha=0.3)
    with batches_of(spark, size):
        got = {(r["segment"], r["number"]): r for r in progress_by_segment(df, "segment", "number", params, report_every=1).collect()}
        some = progress_by_segment(df, "segment", "number", params, report_every=7).collect()
    assert sorted((r["segment"] or 0, r["seq"]) for r in some) == sorted((s, k) for s in (0, 1) for k in range(7, 50, 7))
    for segment in (1, None):
        z, n, held, labels, lost = {}, {}, 0.0, 0.0, 0.0
        own = sorted((r for r in rows if r[0] == segment), key=lambda r: r[1])
        for seq, (_, number, y, features) in enumerate(own, 1):
            w = {}
            for i, _ in features:
                a, b = z.get(i, 0.0), n.get(i, 0.0)
                w[i] = 0.0 if abs(a) <= 0.1 else ((0.1 if a > 0 else -0.1) - a) / (1.0 + (1.0 + b**0.5) / 0.3)
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in features)))
            share = weights[segment, number]
            held, labels = held + share, labels + share * y
            lost -= share * math.log(p if y else 1 - p)
            r = got[segment, number]
            assert r["seq"] == seq
            assert (r["probability"], r["running_base_rate"], r["cumulative_loss"]) == pytest.approx((p, labels / held, lost))
            for i, x in features:
                g, b = share * (p - y) * x, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / 0.3 * w[i]
                n[i] = b + g * g


def test_other_losses(spark):
    squared = RecordLoss(link=lambda m: m, gradient=lambda p, y, x: (p - y) * x, cost=lambda p, y: (p - y) ** 2)
    df = spark.createDataFrame([(1, 1, 2.0, [(1, 1.0)])], ROWS)
    assert [tuple(r)[2:] for r in fit_by_segment(df, "segment", "number", loss=squared).collect()] == [(-2.0, 4.0)]
    log = progress_by_segment(df, "segment", "number", loss=squared, report_every=1).first()
    assert (log["probability"], log["cumulative_loss"]) == (0.0, 4.0)


def test_no_rows(spark):
    df = spark.createDataFrame([], ROWS)
    assert fit_by_segment(df, "segment", "number").count() == 0
    assert progress_by_segment(df, "segment", "number").count() == 0
