import pytest

from clickloom.operators import ftrl
from clickloom.operators.vectorize import vectorize_named
from clickloom.options import ColumnRoles, FtrlParams
from clickloom.sources.staging import stage_in_order
from clickloom.streaming.online import OnlineModel, fit_stream, score_stream

ROLES = ColumnRoles("y", "id", (), ("a", "b"))
LEARNER = ftrl.Ftrl(FtrlParams(l1=0.1), slots=4_000_000)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, i % 3, f"u{i % 11}", f"v{i % 4}", int(i % 5 == 0)) for i in range(240)]
    return spark.createDataFrame(rows, "id int, batch int, a string, b string, y int")


def model(state):
    return {r["idx"]: (round(r["z"], 9), round(r["n"], 9)) for r in ftrl.model_of(state).collect()}


def test_stream_equals_batch_and_repeats_are_harmless(spark, log, tmp_path):
    stream = vectorize_named(stage_in_order(log, "batch", [0, 1, 2], f"{tmp_path}/in", 3), ROLES)
    online = OnlineModel(spark, f"{tmp_path}/model")
    fit_stream(stream, online, f"{tmp_path}/checkpoint", LEARNER)
    batch = ftrl.fit(vectorize_named(log, ROLES, keep=["batch"]), "batch", LEARNER, epochs=1)
    want = model(batch)
    assert model(online.state(3)) == want

    progress = online.progress().orderBy("version").collect()
    assert [(r["version"], r["rows"]) for r in progress] == [(1, 80), (2, 160), (3, 240)]
    assert progress[-1]["label_sum"] == ftrl.progress_of(batch).first()["label_sum"]

    # the last micro-batch once more, as after a failure between the write and the commit
    rows = vectorize_named(log.where("batch = 2"), ROLES)
    online.store(LEARNER.step(online.state(2), rows), 3)
    assert model(online.state(3)) == want


def test_streams_go_on_where_the_model_is(spark, log, tmp_path):
    """Two runs with two checkpoints on top of a batch fit equal one fit over all rows."""
    first = ftrl.fit(vectorize_named(log.where("batch = 0"), ROLES, keep=["batch"]), "batch", LEARNER, epochs=1)
    online = OnlineModel(spark, f"{tmp_path}/model", initial=first)
    for b in (1, 2):
        part = log.where(f"batch = {b}")
        stream = vectorize_named(stage_in_order(part, "batch", [b], f"{tmp_path}/in{b}", 2), ROLES)
        fit_stream(stream, online, f"{tmp_path}/checkpoint{b}", LEARNER)
    whole = ftrl.fit(vectorize_named(log, ROLES, keep=["batch"]), "batch", LEARNER, epochs=1)
    assert model(online.latest()) == model(whole)
    assert online.latest_version() == 2
    assert [r["rows"] for r in online.progress().orderBy("version").collect()] == [160, 240]


def test_rows_outside_the_batches_are_an_error(spark, log, tmp_path):
    with pytest.raises(ValueError, match="would be lost"):
        stage_in_order(log, "batch", [0, 1], f"{tmp_path}/in", 2)


def test_versions_out_of_use_are_dropped(spark, log, tmp_path):
    stream = vectorize_named(stage_in_order(log, "batch", [0, 1, 2], f"{tmp_path}/in", 2), ROLES)
    online = OnlineModel(spark, f"{tmp_path}/model")
    fit_stream(stream, online, f"{tmp_path}/checkpoint", LEARNER)
    assert sorted(p.name for p in (tmp_path / "model" / "states").iterdir()) == ["version=2", "version=3"]


def test_stream_scores_equal_batch_scores(spark, log, tmp_path):
    rows = vectorize_named(log, ROLES)
    state = LEARNER.step(ftrl.empty_state(spark), rows)
    stream = vectorize_named(stage_in_order(log, "batch", [0, 1, 2], f"{tmp_path}/in", 2), ROLES)
    score_stream(stream, state, f"{tmp_path}/out", f"{tmp_path}/checkpoint", LEARNER)
    got = {r["row_id"]: r["probability"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["row_id"]: r["probability"] for r in LEARNER.score(rows, state).collect()}
    assert got == pytest.approx(want)
