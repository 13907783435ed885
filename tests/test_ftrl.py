import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.functions.scalar import Loss, sigmoid
from clickloom.operators import ftrl, lookup
from clickloom.operators.segments import fit_by_segment
from clickloom.options import FtrlParams

SOFT = FtrlParams(l1=0.1)
ROWS = "row_id int, batch int, y double, features array<struct<idx:int,x:double>>"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def one_by_one(rows, p, epochs=1):
    """Record-at-a-time learning with plain Python numbers: the definition the steps are held against."""
    z, n, losses = {}, {}, 0.0
    for _ in range(epochs):
        for _, _, y, cells in rows:
            w = {}
            for i, _ in cells:
                zi, ni = z.get(i, 0.0), n.get(i, 0.0)
                step = p.l2 + (p.beta + math.sqrt(ni)) / p.alpha
                w[i] = 0.0 if abs(zi) <= p.l1 else (math.copysign(p.l1, zi) - zi) / step
            margin = sum(w[i] * x for i, x in cells)
            prob = 1 / (1 + math.exp(-max(-35.0, min(35.0, margin))))
            losses -= math.log(prob if y == 1 else 1 - prob)
            for i, x in cells:
                g = (prob - y) * x
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / p.alpha * w[i]
    return {i: (z[i], n[i]) for i in z}, losses


def model(state):
    return {r["idx"]: (r["z"], r["n"]) for r in ftrl.model_of(state).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12)


def sample(seed, count, slots=25, batch=lambda i: i):
    rng = random.Random(seed)
    return [
        (i, batch(i), float(rng.random() < 0.4), [(s, rng.choice([1.0, 0.5, 2.0])) for s in rng.sample(range(slots), 4)])
        for i in range(count)
    ]


def test_golden_steps(spark):
    learner = ftrl.Ftrl(SOFT, slots=10)
    first = learner.step(ftrl.empty_state(spark), table(spark, [(0, 0, 1.0, [(3, 1.0)])]))
    assert model(first) == {3: (-0.5, 0.25)}
    assert ftrl.weights_of(first, SOFT).first()["w"] == pytest.approx(0.007843137, abs=1e-9)
    assert ftrl.weights_of(first, FtrlParams()).first()["w"] == 0.0
    second = learner.step(first, table(spark, [(0, 0, 0.0, [(3, 1.0)])]))
    assert model(second)[3] == pytest.approx((-0.052547622, 0.501964619), abs=1e-9)


def test_batches_of_one_equal_record_at_a_time(spark):
    rows = sample(11, 12)
    want, losses = one_by_one(rows, SOFT)
    state = ftrl.fit(table(spark, rows), "batch", ftrl.Ftrl(SOFT, slots=25), epochs=1, buckets=2)
    same(model(state), want)
    done = ftrl.progress_of(state).first()
    assert done["rows"] == 12
    assert done["label_sum"] == sum(r[2] for r in rows)
    assert done["loss_sum"] == pytest.approx(losses)


def test_partitioning_does_not_matter(spark):
    df = table(spark, sample(4, 300, batch=lambda i: i % 2))
    learner = ftrl.Ftrl(SOFT, slots=25)
    a = ftrl.fit(df.repartition(1), "batch", learner, buckets=1)
    b = ftrl.fit(df.repartition(9), "batch", learner, buckets=5)
    same(model(a), model(b))


def test_rows_without_a_batch_are_learned_first(spark):
    rows = [(i, None if i < 3 else 1, 1.0, [(i, 1.0)]) for i in range(6)]
    state = ftrl.fit(table(spark, rows), "batch", ftrl.Ftrl(SOFT, slots=25), epochs=1)
    assert model(state).keys() == set(range(6))


def test_large_model_path_gives_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.03)
    df = table(spark, sample(8, 300) + [(1000 + i, 0, 1.0, [(3, 1.0)]) for i in range(150)] + [(5000, 0, 0.0, [])])
    small = ftrl.Ftrl(SOFT, slots=25)
    large = ftrl.Ftrl(SOFT, broadcast_rows=0)
    state = ftrl.fit(df.withColumn("batch", F.lit(0)), "batch", small, epochs=1)
    want = {r["row_id"]: r["probability"] for r in small.score(df, state).collect()}
    got = {r["row_id"]: r["probability"] for r in large.score(df, state).collect()}
    assert want.keys() == got.keys() and want[5000] == 0.5
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r["row_id"]: r["probability"] for r in small.predict(df, state).collect()} == pytest.approx(want)
    same(model(large.step(state, df)), model(small.step(state, df)))


def test_step_on_a_feature_table_shuffles_by_slot_only(spark, plan_of):
    rows = ftrl.FeatureTable.write(table(spark, sample(1, 60, batch=lambda i: i % 3)), "batch", 4)
    learner = ftrl.Ftrl(SOFT, slots=25)
    state = ftrl.fit(rows.rows(0), "batch", learner, epochs=1)
    plan = plan_of(learner.step(state, rows.rows(1)))
    rows.drop()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(idx" in plan


def test_large_steps_learn_like_record_order(spark):
    """A planted signal, default parameters, 8 steps an epoch: within 2% of the loss of record order."""
    rng = np.random.default_rng(7)
    true, rows = rng.normal(0, 1, 150), 12_000
    cells = rng.integers(0, 150, (rows, 4))
    y = (rng.random(rows) < 1 / (1 + np.exp(-true[cells].sum(axis=1)))).astype(float)
    learn, held = range(0, rows - 2_000), range(rows - 2_000, rows)
    p = FtrlParams()

    def loss(w):
        prob = 1 / (1 + np.exp(-w[cells[list(held)]].sum(axis=1)))
        return -np.mean(np.where(y[list(held)] == 1, np.log(prob), np.log(1 - prob)))

    def weights(z, n):
        return np.where(np.abs(z) <= p.l1, 0, (np.sign(z) * p.l1 - z) / (p.l2 + (p.beta + np.sqrt(n)) / p.alpha))

    z, n = np.zeros(150), np.zeros(150)
    for _ in range(2):
        for i in learn:
            at = np.unique(cells[i])
            x = np.array([(cells[i] == a).sum() for a in at], float)
            w = weights(z[at], n[at])
            g = (1 / (1 + np.exp(-(w @ x))) - y[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g * g
    data = [
        (i, i % 8, float(y[i]), [(int(a), float((cells[i] == a).sum())) for a in np.unique(cells[i])]) for i in learn
    ]
    state = ftrl.fit(spark.createDataFrame(data, ROWS), "batch", ftrl.Ftrl(slots=150), epochs=2)
    got = np.zeros(150)
    for r in ftrl.weights_of(state, p).collect():
        got[r["idx"]] = r["w"]
    assert loss(got) <= 1.02 * loss(weights(z, n))


def test_one_result_per_record_whatever_the_ids(spark):
    rows = [(7, 0, 1.0, [(1, 1.0)]), (7, 0, 0.0, [(2, 1.0)]), (None, 0, 1.0, [(1, 1.0)]), (None, 0, 0.0, []), (9, 0, 1.0, [(1, 2.0)])]
    df = spark.createDataFrame(rows, ROWS)
    learner = ftrl.Ftrl(FtrlParams(l1=0.0), slots=10)
    state = spark.createDataFrame([(1, -40.0, 1.0, 1, 0.0, 0.0), (2, 30.0, 1.0, 1, 0.0, 0.0)], ftrl.STATE)
    w = {r["idx"]: r["w"] for r in ftrl.weights_of(state, learner.params).collect()}
    want = sorted(1 / (1 + np.exp(-m)) for m in (w[1], w[2], w[1], 0.0, 2 * w[1]))
    for scored in (learner.score(df, state), learner.predict(df, state)):
        assert sorted(r["probability"] for r in scored.collect()) == pytest.approx(want)
    constant = df.selectExpr("0 AS row_id", "batch", "y", "features")
    one, other = (sorted(map(tuple, learner.step(state, d).collect())) for d in (df, constant))
    assert [r[:5] for r in one] == [pytest.approx(r[:5]) for r in other]


def test_pluggable_loss_and_step(spark):
    squared = Loss(link=lambda m: m, gradient=lambda p, y, x: (p - y) * x, cost=lambda p, y: (p - y) * (p - y))
    learner = ftrl.Ftrl(SOFT, squared, slots=5)
    state = learner.step(ftrl.empty_state(spark), table(spark, [(0, 0, 2.0, [(1, 1.0)])]))
    assert model(state) == {1: (-2.0, 4.0)}
    assert ftrl.progress_of(state).first()["loss_sum"] == 4.0
    seen = []
    kept = ftrl.fit(
        table(spark, sample(2, 6, batch=lambda i: i % 2)),
        "batch",
        step=lambda state, rows: state,
        on_step=lambda epoch, number, state: seen.append((epoch, number)),
    )
    assert model(kept) == {} and seen == [(0, 1), (0, 2), (1, 3), (1, 4)]
    assert sigmoid is ftrl.LOGISTIC.link


@pytest.mark.parametrize("batch_rows", ["1000", "7"])
def test_segments_learn_in_exact_order(spark, batch_rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    rng = random.Random(9)
    rows = sample(6, 90)
    # one segment holds more than a third of the rows
    segment = [rng.choice(["hot", "hot", "a", "b"]) for _ in rows]
    df = spark.createDataFrame(
        [(s, r[0], r[2], r[3]) for s, r in zip(segment, rows, strict=True)],
        "segment string, seq int, y double, features array<struct<idx:int,x:double>>",
    ).repartition(4)
    got = {}
    for r in fit_by_segment(df, "segment", "seq", SOFT).collect():
        got.setdefault(r["segment"], {})[r["idx"]] = (r["z"], r["n"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == set(segment)
    for s in got:
        want, _ = one_by_one([r for r, name in zip(rows, segment, strict=True) if name == s], SOFT)
        same(got[s], want)


def test_weights_stand_for_repeated_rows(spark):
    rows = sample(4, 20, batch=lambda i: i)
    light = spark.createDataFrame([(*r, 1.0 + r[0] % 3) for r in rows], f"{ROWS}, weight double")
    learner = ftrl.Ftrl(SOFT, slots=25)
    state = ftrl.fit(light, "batch", learner, epochs=1)
    z, n, held, labels = {}, {}, 0.0, 0.0
    for i, _, y, features in rows:
        share = 1.0 + i % 3
        w = {k: 0.0 if abs(z.get(k, 0.0)) <= SOFT.l1 else -(z[k] - np.sign(z[k]) * SOFT.l1) / (SOFT.l2 + (SOFT.beta + n[k] ** 0.5) / SOFT.alpha) for k, _ in features}
        p = 1 / (1 + np.exp(-sum(w[k] * x for k, x in features)))
        held, labels = held + share, labels + share * y
        for k, x in features:
            g, b = share * (p - y) * x, n.get(k, 0.0)
            z[k], n[k] = z.get(k, 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / SOFT.alpha * w[k], b + g * g
    got = model(state)
    assert got.keys() == z.keys() and all(got[k] == pytest.approx((z[k], n[k])) for k in z)
    assert ftrl.progress_of(state).first()["base_rate"] == pytest.approx(labels / held)


def test_only_gradients_move_to_a_written_state(spark, plan_of, tmp_path):
    rows = table(spark, sample(4, 40, batch=lambda i: i % 2))
    learner = ftrl.Ftrl(SOFT, slots=25)
    versions = ftrl.Versions(spark, str(tmp_path / "s"))
    state = versions.write(learner.step(ftrl.empty_state(spark), rows), 1)
    stored = ftrl.FeatureTable.write(rows, "batch", 2)
    plan = plan_of(learner.step(state, stored.rows(1)))
    join = plan[plan.index("SortMergeJoin") :]
    left = join[: join.index("Exchange hashpartitioning")]
    assert "Bucketed: true" in left and plan.count("Exchange hashpartitioning") == 1
    stored.drop()
