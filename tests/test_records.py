import csv
import io
import random

import pyarrow as pa
import pytest

from clickloom.options import ColumnRoles, FtrlParams, LearnerOptions
from clickloom.plans.learner import OnlineLearner
from clickloom.session import write_table
from clickloom.sources.records import _pieces, numbered, read_lines_in_place, read_records
from clickloom.sources.text import read_by_name


@pytest.fixture
def small_splits(spark):
    """Splits of a few kilobytes, so that small files have many."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end):
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows(rows)
    path.write_bytes(text.getvalue().encode())


def test_quoted_breaks_over_many_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(4), []
    for name, end in (("a.csv", "\r\n"), ("b.csv", "\n"), ("c.csv", "\n")):
        rows = [[f"{name}{i}", "".join(rng.choice(['x', '"', "\n", ",", "é", " ", "\r\n"]) for _ in range(rng.randint(0, 12)))] for i in range(400)]
        rows[200][1] = '"\n' * 5_000  # wider than several splits
        rows[399][1] = "last\n" * 900 if name == "c.csv" else ""
        write(tmp_path / name, [["id", "t"], *rows], end)
        want += rows
    log = read_by_name(spark, str(tmp_path), place=True)
    assert log.rdd.getNumPartitions() > 10
    got = numbered(write_table(log, "log"), "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1_200))
    assert [(r["id"], r["t"] or "") for r in got] == [tuple(r) for r in want]


def test_records_with_breaks_leave_a_batch_of_lines_together():
    lines = [x for i in range(3_000) for x in (f'{i},"a\r', " ", f'{i}"\r', " \r", f"{i},b")]
    n = len(lines)
    columns = [pa.array(["f"] * n), pa.array([7] * n, pa.int64()), pa.array([False] * n), pa.array(lines)]
    out = list(_pieces(iter([pa.RecordBatch.from_arrays(columns, ["_file", "_block", "odd", "value"]).slice(2, n - 4)])))
    whole = [r for batch in out for r in batch.to_pylist() if r["part"] == 0]
    # the first line left closes a quote and so opens one here
    assert len(out) <= 3
    assert [r["_place"] for r in whole] == list(range(len(whole)))

    out = list(_pieces(iter([pa.RecordBatch.from_arrays(columns, ["_file", "_block", "odd", "value"])])))
    assert len(out) <= 3
    want = [r for i in range(3_000) for r in (f'{i},"a\r\n \n{i}"', f"{i},b")]
    assert [(r["_file"], r["_block"], r["_place"], r["record"], r["part"]) for b in out for r in b.to_pylist()] == [
        ("f", 7, k, r, 0) for k, r in enumerate(want)
    ]


def test_blank_records_and_files_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n\n1,x\n   \n"2","\n"\n\n')
    (tmp_path / "b.csv").write_text("id,t\n")
    (tmp_path / "c.csv").write_text("")
    assert sorted(tuple(r) for r in read_by_name(spark, str(tmp_path)).collect()) == [("1", "x"), ("2", "\n")]


def test_unclosed_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="a quote is not closed"):
        read_records(spark, str(tmp_path)).collect()


def test_row_that_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n1,x,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_by_name(spark, str(tmp_path)).collect()


def test_lines_keep_their_order_over_splits(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k},{i}\n" for i in range(2_000)))
    lines = numbered(write_table(read_lines_in_place(spark, str(tmp_path)), "lines"), "n").orderBy("n").collect()
    assert [r["value"] for r in lines] == [f"{k},{i}" for k in range(3) for i in range(2_000)]
    assert [r["n"] for r in lines] == list(range(6_000))


def test_steps_do_not_depend_on_ids_or_splits(spark, tmp_path):
    roles = ColumnRoles("click", "id", (), ("site",))
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), rng.randrange(9)) for _ in range(700)]
    states = []
    for name, ident, split in (("own", lambda i: i, "128MB"), ("same", lambda i: "x", "500"), ("none", lambda i: "", "3000")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "log.csv").write_text("id,click,site\n" + "".join(f"{ident(i)},{y},{s}\n" for i, (y, s) in enumerate(rows)))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        seen = []
        learner = OnlineLearner(spark, roles, FtrlParams(0.1, alpha=0.3), LearnerOptions(epochs=1), batches=8)
        plain = learner.learner.step
        learner.step = lambda state, batch, seen=seen, plain=plain: (seen.append(batch.count()), plain(state, batch))[1]
        learner.fit_csv(str(tmp_path / name))
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert seen == [88] * 7 + [84]
        states.append({r["idx"]: (round(r["z"], 9), round(r["n"], 9)) for r in learner.state.collect()})
    assert states[0] == states[1] == states[2]
