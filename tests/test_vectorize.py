import pytest

from clickloom.functions.hashing import slot_number
from clickloom.operators.vectorize import (
    POSITIONAL_OFFSET,
    OneHotIndex,
    cells,
    vectorize_named,
    vectorize_positional,
)
from clickloom.options import ColumnRoles, LearnerOptions

ROLES = ColumnRoles("y", "id", ("n",), ("a", "b"))


def features(df):
    return {r["row_id"]: {c["idx"]: c["x"] for c in r["features"]} for r in df.collect()}


def test_named_rows(spark):
    df = spark.createDataFrame([(1, 0.0, "u", None, 1)], "id int, n double, a string, b string, y int")
    want = {0: 0.0, slot_number("a_u", 4_000_000) + 1: 1.0, slot_number("b_", 4_000_000) + 1: 1.0}
    assert features(vectorize_named(df, ROLES)) == {1: want}


def test_equal_slots_add_up(spark):
    df = spark.createDataFrame([(1, 2.5, "u", "v", 1)], "id int, n double, a string, b string, y int")
    assert features(vectorize_named(df, ROLES, LearnerOptions(max_features=1))) == {1: {0: 2.5, 1: 2.0}}


def test_missing_number_is_an_error(spark):
    df = spark.createDataFrame([(1, None, "u", "v", 1)], "id int, n double, a string, b string, y int")
    with pytest.raises(Exception, match="missing number"):
        vectorize_named(df, ROLES).collect()


def positional(spark, fields, **options):
    roles = ColumnRoles("0", "id", ("1", "2"), ("3", "4"))
    df = spark.createDataFrame([(1, fields)], "id int, fields array<string>")
    return features(vectorize_positional(df, "fields", roles, **options))[1]


def test_positional_rows(spark):
    hashed = {slot_number("4_3", 4_000_000) + 2: 1.0}
    assert positional(spark, ["1", "0", "2", "0", "3"]) == {1: 2.0, **hashed}
    assert positional(spark, ["1", "0", "2", "0", "3"], offset=POSITIONAL_OFFSET) == {1: 21.0, **hashed}
    assert positional(spark, ["1", "-4", "2", "0", "3"], positive_only=False) == {0: -4.0, 1: 2.0, **hashed}


def test_positional_rejects_bad_numbers(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        positional(spark, ["1", "x", "2", "0", "3"])


def test_rows_without_cells_have_no_long_form(spark):
    roles = ColumnRoles("0", "id", (), ("1",))
    df = spark.createDataFrame([(1, ["1", "0"]), (2, ["0", "5"])], "id int, fields array<string>")
    rows = vectorize_positional(df, "fields", roles)
    assert rows.count() == 2
    assert [r["row_id"] for r in cells(rows).collect()] == [2]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_one_hot_numbers_pairs_behind_the_numbers(spark, broadcast_rows):
    df = spark.createDataFrame(
        [(1, 1.0, "u", "v", 1), (2, 3.0, "w", "v", 0)], "id int, n double, a string, b string, y int"
    )
    index = OneHotIndex.fit(df, ROLES)
    numbered = {(r["feature"], r["value"]): r["idx"] for r in index.entries.table.collect()}
    assert numbered == {("a", "u"): 1, ("a", "w"): 2, ("b", "v"): 3}
    assert index.slots == 4
    new = spark.createDataFrame([(9, 7.0, "w", "never", 0)], df.schema)
    assert features(index.transform(df.union(new), broadcast_rows=broadcast_rows)) == {
        1: {0: 1.0, 1: 1.0, 3: 1.0},
        2: {0: 3.0, 2: 1.0, 3: 1.0},
        9: {0: 7.0, 2: 1.0},
    }
