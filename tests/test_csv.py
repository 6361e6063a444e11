"""Quoted CSV read by ranges, cut in every place."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from voxtide.session import scratch_path
from voxtide.sources import csv_ranges, files

SCHEMA = "id int, body string, n int"
ROWS = [(1, "plain", 5), (2, 'say "hi",\nnew line', 6), (3, "\n\n\n", 7), (4, '"', 8), (5, "a,b", None), (6, 'x""\n"', 9), (7, None, 1),
        (8, "long " * 30 + "\n" + "text\n" * 20, 2), (9, " blanks ", 3), (10, "é\n𝟗", 4)]


def as_text(rows):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "body", "n"])
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue()


@pytest.fixture()
def small_ranges(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("size", [7, 16, 33, 128 << 20])
def test_cut_everywhere(spark, tmp_path, small_ranges, size):
    """Ranges of a few bytes: quoted line breaks and quotes fall on their edges, records run through several."""
    for name, some in (("a.csv", ROWS), ("b.csv", ROWS[::-1])):
        (tmp_path / name).write_text(as_text(some), encoding="utf-8")
    small_ranges(size)
    schema = spark.createDataFrame([], SCHEMA).schema
    got = csv_ranges.read_quoted_csv(spark, str(tmp_path), schema).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(ROWS * 2, key=key)
    small_ranges(128 << 20)
    plain = spark.read.schema(schema).csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"').collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, plain), key=key)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text(as_text([(i, f"text {i}\nand more", i) for i in range(2000)]), encoding="utf-8")
    small_ranges(4096)
    found = csv_ranges.records(spark, str(tmp_path))
    assert found.count() == 2001 and found.select("start").distinct().count() > 10
    assert csv_ranges._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10


def test_header_only_and_empty_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,body,n\n")
    (tmp_path / "b.csv").write_text("id,body,n\r\n\r\n1,x,2\r\n")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert list(map(tuple, csv_ranges.read_quoted_csv(spark, str(tmp_path), schema).collect())) == [(1, "x", 2)]


def test_series_file(spark):
    path = scratch_path(spark, "series")
    series = spark.createDataFrame([(3, "2024-02-01"), (1, "2024-01-01")], "count bigint, period string").withColumn("period", F.to_date("period"))
    files.write_series(series, path)
    back = spark.read.csv(path, header=True, inferSchema=True)
    assert back.columns == ["period", "count"] and sorted(r["count"] for r in back.collect()) == [1, 3]
