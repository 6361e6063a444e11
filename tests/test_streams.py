import datetime as dt

from pyspark.sql import functions as F

from voxtide.functions.lexicon import score_sentiment
from voxtide.operators.inference import score_with_model
from voxtide.session import scratch_path
from voxtide.streaming import ingest

SCHEMA = "id bigint, ts timestamp_ntz, student_id string, value double, text string"


def arrived(spark, rows):
    folder = scratch_path(spark, "arrivals")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_collection_drops_repeats(spark):
    rows = [(1, at(1), "", 1.0, "a"), (1, at(1, 1), "", 1.0, "a"), (2, at(1, 2), "S2", 2.0, "b")]
    out = ingest.run_available(ingest.collect_submissions(arrived(spark, rows), ["id"], "ts"), "c").collect()
    assert {(r["id"], r["student_id"], r["course_id"]) for r in out} == {(1, "anonymous", "unknown"), (2, "S2", "unknown")}


def test_closed_days_equal_batch(spark):
    rows = [(i, at(1 + i % 9, i % 24), "s", float(i), "t") for i in range(200)]
    daily = ingest.run_available(ingest.volume_per_day(arrived(spark, rows), "ts", "value"), "v")
    got = {r["period"]: (r["count"], r["mean"]) for r in daily.collect()}
    batch = spark.createDataFrame(rows, SCHEMA).groupBy(F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    want = {r["d"]: (r["n"], r["m"]) for r in batch.collect()}
    assert got and all(want[d] == v for d, v in got.items())
    assert dt.date(2024, 1, 9) not in got  # the last day is still open


def test_scoring_on_arrival(spark):
    rows = [(1, at(1), "s", 1.0, "great"), (2, at(1), "s", 1.0, "bad")]
    scored = ingest.score_stream(arrived(spark, rows), lambda df: score_sentiment(df, "text"))
    out = {r["id"]: r["predicted_sentiment"] for r in ingest.run_available(scored, "s").collect()}
    assert out == {1: "Positive", 2: "Negative"}


def test_model_failures_are_neutral(spark):
    def load():
        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("cannot score")
            return [("POSITIVE" if "good" in t else "OTHER", 0.75) for t in texts]

        return model

    df = spark.createDataFrame([(1, "good"), (2, "boom"), (3, "so so"), (4, None)], "id int, text string").coalesce(1)
    out = {r["id"]: (r["predicted_sentiment"], r["confidence"]) for r in score_with_model(df, "text", load).collect()}
    assert out == {1: ("Positive", 0.75), 2: ("Neutral", 0.0), 3: ("Neutral", 0.75), 4: ("Neutral", 0.75)}


def test_a_batch_that_runs_again_changes_nothing(spark):
    """The same batch, written a second time, replaces itself; later rows come in a batch of their own."""
    folder, progress = scratch_path(spark, "rows"), scratch_path(spark, "progress")
    source = scratch_path(spark, "arrivals")
    spark.createDataFrame([(1, at(1), "s", 1.0, "a"), (2, at(1), "s", 2.0, "b")], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    double = lambda df: df.select("id", (F.col("value") * 2).alias("value"))
    ingest.write_batches(stream, double, folder, progress)
    again = scratch_path(spark, "progress")  # progress was lost: the first batch runs again
    ingest.write_batches(stream, double, folder, again)
    assert sorted((r["id"], r["value"]) for r in spark.read.parquet(folder).collect()) == [(1, 2.0), (2, 4.0)]
    spark.createDataFrame([(3, at(2), "s", 5.0, "c")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    ingest.write_batches(spark.readStream.schema(SCHEMA).parquet(source), double, folder, again)
    assert sorted((r["id"], r["value"]) for r in spark.read.parquet(folder).collect()) == [(1, 2.0), (2, 4.0), (3, 10.0)]


def test_repeats_however_late_are_stored_once(spark):
    """Repeats in a batch, in a later batch after a restart, from another source, and a batch that runs again."""
    source, folder, progress = scratch_path(spark, "arrivals"), scratch_path(spark, "store"), scratch_path(spark, "progress")

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def kept():
        return sorted((r["id"] or 0, r["value"], r["student_id"], r["course_id"]) for r in ingest.collected(spark, folder).collect())

    def collect(name="form", progress=progress):
        ingest.collect_once(spark.readStream.schema(SCHEMA).parquet(source), ["id"], "ts", folder, progress, name)

    arrive((1, at(1, 5), "", 1.5, "later"), (1, at(1), "", 1.0, "a"), (2, at(1), "s", 2.0, "b"), (None, at(1), "s", 0.0, "n"), (None, at(1), "s", 0.0, "n"))
    collect()
    first = [(0, 0.0, "s", "unknown"), (0, 0.0, "s", "unknown"), (1, 1.0, "anonymous", "unknown"), (2, 2.0, "s", "unknown")]
    assert kept() == first
    arrive((1, at(11), "s", 9.0, "ten days later"), (3, at(11), "s", 3.0, "c"))
    collect()
    assert kept() == [*first, (3, 3.0, "s", "unknown")]
    collect("other", scratch_path(spark, "progress"))  # the same files under another name: all but the nameless are known
    assert kept() == [*first[:2], *first[:2], *first[2:], (3, 3.0, "s", "unknown")]


def test_an_empty_arrival(spark):
    folder = scratch_path(spark, "store")
    ingest.collect_once(arrived(spark, []), ["id"], "ts", folder, scratch_path(spark, "progress"))
    assert ingest.collected(spark, folder).count() == 0


def test_a_batch_of_submissions_that_runs_again(spark):
    folder, rows = scratch_path(spark, "store"), [(1, at(1), "s", 1.0, "a"), (2, at(2), "s", 2.0, "b"), (2, at(3), "s", 3.0, "c")]
    stream = arrived(spark, rows)
    for _ in range(2):  # progress was lost, the same batch runs again under its own name
        ingest.collect_once(stream, ["id"], "ts", folder, scratch_path(spark, "progress"))
        assert sorted((r["id"], r["value"]) for r in ingest.collected(spark, folder).collect()) == [(1, 1.0), (2, 2.0)]


def test_table_that_is_a_folder(spark):
    """A stream over a table finds its rows whether the table is one file or a folder of files."""
    folder = scratch_path(spark, "tables")
    rows = [(i, at(1), "s", 1.0, "great") for i in range(9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/talk.parquet")
    talk = ingest.stream_table(spark, folder, "talk", spark.read.parquet(f"{folder}/talk.parquet").schema)
    scored = ingest.score_new(talk, lambda df: score_sentiment(df, "text"), "talk")
    assert sorted(r["id"] for r in scored.collect()) == list(range(9))


def test_nothing_has_arrived(spark):
    empty = arrived(spark, [])
    scored = ingest.score_new(empty, lambda df: score_sentiment(df, "text"), "none")
    assert scored.count() == 0 and "predicted_sentiment" in scored.columns
