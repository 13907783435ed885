import pytest
from pyspark.sql import functions as F

from clickloom import session
from clickloom.sources import sinks, tables, text


def test_click_log(spark, tmp_path):
    assert len(text.CLICK_LOG_COLUMNS) == 24 and len(text.CLICK_LOG_FEATURES) == 23
    fields = [f"v{i}" for i in range(24)]
    fields[1], fields[5] = "1", ""
    (tmp_path / "log.csv").write_text(",".join(text.CLICK_LOG_COLUMNS) + "\n" + ",".join(fields) + "\n")
    row = text.read_click_log(spark, str(tmp_path)).first()
    assert (row["id"], row["click"], row["site_id"], row["C21"]) == ("v0", 1, None, "v23")


def test_quoted_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", twice', 0.5), (2, "plain", None)]
    df = spark.createDataFrame(rows, "id int, t string, v double")
    sinks.write_csv(df, str(tmp_path / "out"))
    got = text.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert {tuple(r) for r in got.collect()} == set(rows)


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,t\n1,"two\nlines"\n2,one\n')
    got = text.read_csv(spark, str(tmp_path), "id int, t string", multi_line=True)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "two\nlines"), (2, "one")]


def test_bad_number_in_csv_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,v\n1,x\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        text.read_csv(spark, str(tmp_path), "id int, v int").collect()


def test_lines_by_position(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([("1,a,2.5",), ("0,,x",)], "value string"), str(tmp_path / "l"))
    lines = text.read_lines(spark, str(tmp_path / "l"))
    columns = [("y", "int"), ("c", "string"), ("v", "double")]
    got = text.parse_lines(lines, columns, strict=False)
    assert {tuple(r) for r in got.collect()} == {(0, "", None), (1, "a", 2.5)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.parse_lines(lines, columns).collect()


def test_single_file_is_an_option(spark, tmp_path):
    df = spark.range(100).repartition(4).select(F.col("id").cast("string").alias("value"))
    sinks.write_lines(df, str(tmp_path / "many"))
    sinks.write_lines(df, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "many").glob("part-*"))) == 4
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_submission_has_id_and_click(spark, tmp_path):
    scores = spark.createDataFrame([(7, 0.25)], "row_id bigint, probability double")
    sinks.write_submission(scores, str(tmp_path / "s"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert written.replace("id,click\n", "") == "7,0.25\n" and written.startswith("id,click\n")
    sinks.write_submission(scores, str(tmp_path / "one"), single_file=True)
    assert next((tmp_path / "one").glob("part-*")).read_text() == "id,click\n7,0.25\n"


def test_csv_keeps_blanks_empty_text_and_line_breaks(spark, tmp_path):
    rows = [(1, "  lead "), (2, ""), (3, None), (4, "two\nlines"), (5, 'a "quote", b')]
    df = spark.createDataFrame(rows, "id bigint, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = text.read_by_name(spark, str(tmp_path / "c")).collect()
    assert sorted((int(r["id"]), r["t"]) for r in back) == rows


def test_overwrite_replaces_and_delete_removes(spark, tmp_path):
    path = str(tmp_path / "d")
    for n in (3, 1):
        sinks.write_csv(spark.range(n), path)
    assert text.read_csv(spark, path, "id bigint").count() == 1
    assert session.delete_directory(spark, path) is True
    assert not (tmp_path / "d").exists()
    assert session.delete_directory(spark, path) is False


def test_intermediate_tables_go_to_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    path = session.new_path(spark, "x")
    assert path.startswith(session.shared_dir(spark))
    if configured:
        assert path.startswith(configured)


def test_click_log_of_one_partition_is_written_by_many_tasks(spark, tmp_path):
    made = spark.range(0, 120_000, 1, 1).selectExpr(
        "id AS event_id", "timestamp_seconds(id * 60) AS ts", "id % 90 AS user_id",
        "IF(id % 3 = 0, 'click', 'view') AS event_type", "double(id % 11) AS value", "concat('{\"k\": ', id % 5, '}') AS props",
    )
    made.write.parquet(f"{tmp_path}/events.parquet")
    tables.click_log_csv(spark, str(tmp_path), f"{tmp_path}/log")
    log = text.read_click_log(spark, f"{tmp_path}/log")
    assert len(log.inputFiles()) == min(spark.sparkContext.defaultParallelism, 3)
    assert sorted(int(r["id"]) for r in log.select("id").collect()) == list(range(120_000))
