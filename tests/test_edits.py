"""Stored tables and their edits."""

import pytest
from pyspark.sql import functions as F

from voxtide.operators.edits import KeptTable
from voxtide.operators.rows import update_rows


def test_edits_are_read_back(spark, tmp_path):
    kept = KeptTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        kept.table()
    kept.replace(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string"))
    missing = kept.update(spark.createDataFrame([(2, "z", 1), (9, "y", 1)], "k int, x string, at int"), "k", "at")
    assert [r["k"] for r in missing.collect()] == [9]
    other = KeptTable(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, other.table().collect())) == [(1, "a"), (2, "z"), (3, "c")]
    assert [r["k"] for r in other.delete(spark.createDataFrame([(1,), (7,)], "k int"), "k").collect()] == [7]
    assert sorted(map(tuple, kept.table().collect())) == [(2, "z"), (3, "c")]
    assert sorted(map(tuple, kept.table(1).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    kept.forget()
    assert kept.versions() == [2, 3]


def test_an_edit_that_fails_changes_nothing(spark, tmp_path):
    kept = KeptTable(spark, str(tmp_path / "t"))
    kept.replace(spark.createDataFrame([(1, "a")], "k int, x string"))
    bad = spark.createDataFrame([(1, "b")], "k int, x string").withColumn("x", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        kept.update(bad, "k", None)
    assert kept.versions() == [1] and kept.table().first()["x"] == "a"
    kept.update(spark.createDataFrame([(1, "c", 0)], "k int, x string, at int"), "k", "at")
    assert kept.table().first()["x"] == "c"


@pytest.mark.parametrize("parts", [1, 5])
def test_last_update_by_a_column(spark, parts):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    updates = [(1, "new", 9), (1, "old", 3), (1, "null", None), (2, None, 5), (2, "b2", 4)]
    for rows in (updates, updates[::-1]):
        df = spark.createDataFrame(rows, "k int, x string, at int").repartition(parts)
        assert sorted(map(tuple, update_rows(base, df, "k", "at").collect())) == [(1, "new"), (2, None)]
