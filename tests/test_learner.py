import random

import pytest

from clickloom.operators.ftrl import progress_of
from clickloom.operators.vectorize import OneHotIndex
from clickloom.options import ColumnRoles, FtrlParams, LearnerOptions
from clickloom.plans.learner import OnlineLearner
from clickloom.sources.text import read_by_name

ROLES = ColumnRoles("click", "id", ("n",), ("site", "app"))
PARAMS = FtrlParams(l1=0.1, alpha=0.3)


@pytest.fixture(scope="module")
def log_path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    lines = ["id,click,site,app,n"]
    lines += [f'{i},{int(i % 6 < 2)},"s,{i % 6}",a{i % 5},{i % 3}' for i in range(600)]
    (folder / "log.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.mark.parametrize("hash_trick", [True, False])
def test_named_csv(spark, log_path, tmp_path, hash_trick):
    options = LearnerOptions(hash_trick=hash_trick, epochs=2)
    model = OnlineLearner(spark, ROLES, PARAMS, options, batches=2).fit_csv(log_path)
    assert model.base_rate().first()[0] == pytest.approx(200 / 600)
    report = model.evaluate_csv(log_path).first()
    assert report["auc"] > 0.95 and report["rows"] == 600
    scores = {r["id"]: r["probability"] for r in model.predict_probability(log_path).collect()}
    assert len(scores) == 600 and all(0 < p < 1 for p in scores.values())
    classes = {r["id"]: r["class"] for r in model.predict_class(log_path).collect()}
    assert all(classes[i] == (1 if scores[i] >= 1 / 3 else -1) for i in scores)
    model.write_submission(log_path, f"{tmp_path}/out")
    written = read_by_name(spark, f"{tmp_path}/out")
    assert written.columns == ["id", "click"]
    assert {r["id"]: float(r["click"]) for r in written.collect()} == pytest.approx(scores)


def test_scoring_needs_no_target(spark, log_path, tmp_path):
    model = OnlineLearner(spark, ROLES, PARAMS, LearnerOptions(epochs=1), batches=1).fit_csv(log_path)
    (tmp_path / "new.csv").write_text("n,id,app,site\n1,x,a1,s9\n")
    assert [r["id"] for r in model.predict_probability(str(tmp_path)).collect()] == ["x"]


def test_positional_file(spark, tmp_path):
    (tmp_path / "leaf").write_text("".join(f"{int(i % 4 == 0)},{int(i % 4 == 0)},{int(i % 4 != 0)}\n" for i in range(200)))
    roles = ColumnRoles("0", "id", (), ("1", "2"))
    model = OnlineLearner(spark, roles, PARAMS, LearnerOptions(epochs=2), batches=2).fit_file(str(tmp_path))
    report = model.evaluate_file(str(tmp_path)).first()
    assert (report["auc"], report["accuracy"], report["rows"]) == (1.0, 1.0, 200)


def test_unfitted_learner_says_so(spark, log_path):
    with pytest.raises(ValueError, match="fit the learner first"):
        OnlineLearner(spark, ROLES).predict_probability(log_path)


@pytest.mark.parametrize("single_file", [False, True])
def test_submission_keeps_the_order_of_the_input(spark, tmp_path, single_file):
    ids = [(i * 7919) % 1000 for i in range(1000)]
    (tmp_path / "log.csv").write_text("id,click,site,app,n\n" + "".join(f"{i},{i % 2},s{i % 3},a,1\n" for i in ids))
    model = OnlineLearner(spark, ROLES, PARAMS, LearnerOptions(epochs=1), batches=1).fit_csv(str(tmp_path / "log.csv"))
    model.write_submission(str(tmp_path / "log.csv"), f"{tmp_path}/out", single_file=single_file)
    out = tmp_path / "out"
    files = [out] if single_file else sorted(out.glob("part-*"))
    lines = "".join(p.read_text() for p in files).splitlines()
    assert lines[0] == "id,click" and [int(x.split(",")[0]) for x in lines[1:]] == ids


def test_refit_keeps_the_numbers_of_the_first_fit(spark, tmp_path):
    for name, sites in (("one", "bd"), ("two", "abcd")):
        rows = "".join(f"{i},{i % 2},{sites[i % len(sites)]},x,1\n" for i in range(200))
        (tmp_path / name).write_text("id,click,site,app,n\n" + rows)
    model = OnlineLearner(spark, ROLES, PARAMS, LearnerOptions(hash_trick=False, epochs=1), batches=2)
    numbers = []
    for name in ("one", "two", "two"):
        model.fit_csv(str(tmp_path / name))
        numbers.append({(r["feature"], r["value"]): r["idx"] for r in model.index.entries.table.collect()})
    assert numbers[0] == {("app", "x"): 1, ("site", "b"): 2, ("site", "d"): 3}
    assert numbers[1] == numbers[2] == numbers[0] | {("site", "a"): 4, ("site", "c"): 5}
    assert model.learner.slots == 6


def test_many_refits_leave_one_dictionary(spark):
    index = None
    for k in range(12):
        df = spark.createDataFrame([(1, 0, 1.0, f"s{k}", "a")], "id int, click int, n double, site string, app string")
        index = index.refit(df) if index else OneHotIndex.fit(df, ROLES)
    assert {r["value"]: r["idx"] for r in index.entries.table.where("feature = 'site'").collect()} == {f"s{k}": k + 2 for k in range(12)}
    assert index.entries.parts < 12 and index.slots == 14


def test_positional_file_without_hashing(spark, tmp_path):
    (tmp_path / "leaf").write_text("".join(f"{int(i % 4 == 0)},{int(i % 4 == 0)},{int(i % 4 != 0)},{i % 3 - 1}\n" for i in range(200)))
    roles = ColumnRoles("0", "id", ("3",), ("1", "2"))
    model = OnlineLearner(spark, roles, PARAMS, LearnerOptions(hash_trick=False), batches=2).fit_file(str(tmp_path))
    assert {(r["feature"], r["value"], r["idx"]) for r in model.index.entries.table.collect()} == {("1", "1", 1), ("2", "1", 2)}
    report = model.evaluate_file(str(tmp_path)).first()
    assert (report["auc"], report["rows"]) == (1.0, 200)


def test_sampled_negatives_learn_nearly_the_same(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, a, int(rng.random() < 0.05 + 0.3 * (s == 1) + 0.2 * (a == 2))) for s, a in ((rng.randrange(4), rng.randrange(4)) for _ in range(6_000))]
    (tmp_path / "log.csv").write_text("id,click,site,app,n\n" + "".join(f"x,{y},s{s},a{a},1\n" for s, a, y in rows))
    reports, sizes = [], []
    for keep in (100, 30):
        options = LearnerOptions(epochs=3, keep_negatives=keep)
        model = OnlineLearner(spark, ROLES, PARAMS, options, batches=16).fit_csv(str(tmp_path))
        reports.append(model.evaluate_csv(str(tmp_path)).first())
        progress = progress_of(model.state).first()
        sizes.append(progress["rows"])
        assert progress["base_rate"] == pytest.approx(sum(y for *_, y in rows) / len(rows), abs=0.02)
    assert sizes[1] < 0.5 * sizes[0]
    assert reports[1]["logloss"] < 1.03 * reports[0]["logloss"] and reports[1]["auc"] > reports[0]["auc"] - 0.03
    with pytest.raises(ValueError, match="no batch column"):
        OnlineLearner(spark, ROLES, options=LearnerOptions(keep_negatives=30), batch="n").fit_csv(str(tmp_path))
