import pytest

from clickloom.operators.running import rank_rows
from clickloom.session import new_path, path_exists, scratch, shared_dir, write_table


def test_scratch_goes_with_its_block(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 7 AS k")
    with scratch(spark) as folder:
        assert folder.startswith(shared_dir(spark)) and new_path(spark, "x").startswith(folder)
        ranked = rank_rows(rows, ["k", "id"])
        assert path_exists(spark, folder)
        ranked.write.parquet(str(tmp_path / "out"))
        with scratch(spark, "inner") as inner:
            assert inner.startswith(folder) and write_table(rows, "rows").count() == 100
        assert not path_exists(spark, inner) and path_exists(spark, folder)
    assert not path_exists(spark, folder) and not new_path(spark, "x").startswith(folder)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_scratch_goes_when_a_job_fails(spark):
    with pytest.raises(ZeroDivisionError), scratch(spark) as folder:
        write_table(spark.range(3), "rows")
        _ = 1 / 0
    assert not path_exists(spark, folder)
