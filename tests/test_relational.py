import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.functions import dates
from voxtide.operators import metrics, quantiles, rows, series, stats
from voxtide.operators.numbering import number_rows, rank_in_groups
from voxtide.operators.store import Store, known_texts, label_rows
from voxtide.schemas import COLLECTED, require_columns
from voxtide.session import scratch_path
from voxtide.sources import files


def dated(spark, pairs):
    return spark.createDataFrame([(dt.date.fromisoformat(d), v) for d, v in pairs], "date date, rating int")


def test_month_gap(spark):
    df = dated(spark, [("2024-01-05", 4), ("2024-01-20", 2), ("2024-03-01", 5), ("2024-03-02", None)])
    volume = [(str(r["period"]), r["count"]) for r in series.volume(df).orderBy("period").collect()]
    assert volume == [("2024-01-31", 2), ("2024-02-29", 0), ("2024-03-31", 2)]
    trend = series.rating_trend(df).orderBy("period").collect()
    assert [(r["mean"], r["count"]) for r in trend] == [(3.0, 2), (None, 0), (5.0, 1)]
    assert round(trend[0]["std"], 6) == 1.414214 and trend[2]["std"] is None
    sums = {str(r["period"]): r["rating"] for r in series.column_series(df, "rating", "sum").collect()}
    assert sums == {"2024-01-31": 6, "2024-02-29": 0, "2024-03-31": 5}
    labels = series.label_trend(df.withColumn("s", F.lit("a")), "s")
    assert labels.count() == 2  # periods that do not occur are left out
    assert series.label_trend(df.withColumn("s", F.lit("a")), "s", dense=True).count() == 3
    with pytest.raises(ValueError):
        series.column_series(df, "rating", "median")
    with pytest.raises(ValueError):
        series.volume(df, freq="hour")


def test_period_labels(spark):
    day = F.lit("2024-05-15").cast("date")  # a Wednesday
    want = {"D": "2024-05-15", "W": "2024-05-19", "M": "2024-05-31", "Q": "2024-06-30", "Y": "2024-12-31"}
    got = spark.range(1).select(*[dates.period_end(day, f).alias(f) for f in want]).first().asDict()
    assert {k: str(v) for k, v in got.items()} == want


def test_empty_series(spark):
    empty = dated(spark, [])
    assert series.volume(empty).count() == 0
    assert series.detect_anomalies(series.volume(empty), "count").count() == 0


def test_rolling_anomalies(spark):
    values = [10, 11, 10, 11, 10, 11, 10, 60]
    df = spark.createDataFrame([(dt.date(2024, 1, i + 1), v) for i, v in enumerate(values)], "period date, count int")
    six = series.detect_anomalies(df, "count", 6, 2.0).orderBy("period").collect()
    assert [r["anomaly"] for r in six] == [0] * 7 + [1]
    assert all(r["rolling_mean"] is None and r["upper_bound"] is None for r in six[:5])
    three = series.detect_anomalies(df, "count").collect()
    assert {r["anomaly"] for r in three} == {0}
    past = series.detect_anomalies(df, "count", 3, 2.0, exclude_current=True).orderBy("period").collect()
    assert past[-1]["anomaly"] == 1
    table = series.anomaly_table(series.detect_anomalies(df, "count", 6, 2.0)).collect()
    assert [(r["count"], r["anomaly_type"]) for r in table] == [(60, "High Volume")]
    short = series.detect_anomalies(df.limit(5), "count", 2, 0.1)
    assert series.anomaly_table(short).count() == 0


def test_combined_series(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 5, "Positive", "b b"), (dt.date(2024, 3, 1), 1, "Negative", "a"), (dt.date(2024, 3, 2), 2, "Negative", "a")],
        "date date, rating int, true_sentiment string, true_category string",
    )
    out = series.combined_series(df, top=1).orderBy("period").collect()
    assert out[0].asDict().keys() == {"period", "feedback_count", "avg_rating", "Negative", "Positive", "category_a"}
    assert [(r["feedback_count"], r["Negative"], r["category_a"]) for r in out] == [(1, 0, 0), (0, 0, 0), (2, 2, 2)]


def test_quantiles_agree(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.when(F.col("id") % 5 == 0, F.lit(0.5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"),
    )
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    exact = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", probabilities).alias("q")).collect()}
    narrow = {r["g"]: r["quantiles"] for r in quantiles.quantiles(df, ["g"], "v", probabilities).collect()}
    assert exact.keys() == narrow.keys()
    for g in exact:
        assert narrow[g] == pytest.approx(exact[g], rel=1e-12)
    whole = quantiles.quantiles(df, [], "v", [0.5]).first()[0]
    assert whole == pytest.approx(df.agg(F.percentile("v", [0.5])).first()[0])


def test_quantiles_of_nan_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, float("nan"), None, 4.0, float("inf"))] + [("b", None)], "g string, v double")
    out = {r["g"]: r["quantiles"] for r in quantiles.quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert out == {"a": [1.0, 3.0, float("inf")]}
    assert quantiles.quantiles(df.limit(0), [], "v", [0.5]).first()[0] == []
    told = stats.describe(df.where("v is null or v < 9"), ["v"]).first()
    assert (told["count"], told["min"], told["p50"], told["max"]) == (3, 1.0, 2.0, 4.0)


def test_box_stats(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 100)] + [("b", 7)], "g string, v int")
    out = {r["g"]: r for r in stats.box_stats(df, "g", "v").collect()}
    assert (out["a"]["q1"], out["a"]["q2"], out["a"]["q3"]) == (2, 3, 4)
    assert (out["a"]["whisker_low"], out["a"]["whisker_high"], out["a"]["outliers"]) == (1, 4, 1)
    assert out["b"]["outliers"] == 0


def test_counts_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert [tuple(r) for r in stats.value_counts(df, "c").collect()] == [("a", 2), ("b", 2)]
    assert [tuple(r) for r in stats.value_shares(df, "c").collect()] == [("a", 2, 40.0), ("b", 2, 40.0)]
    assert stats.label_share(df.where("false"), "c", "a").first()[0] == 0.0
    values = [0.0, 0.1, 0.3, 0.6, 0.7, 0.999, 1.0]  # many lie on or next to an edge
    edges = spark.createDataFrame([(x,) for x in values], "x double")
    found = {r["bin"] - 1: r["count"] for r in stats.histogram(edges, "x", 0, 1, 10).collect()}
    want = np.histogram(values, bins=10, range=(0, 1))[0]
    assert found == {i: n for i, n in enumerate(want) if n}


def test_empty_collection_stats(spark):
    empty = spark.createDataFrame([], COLLECTED)
    out = {r["metric"]: r["value"] for r in stats.collection_stats(empty, "rating", ["subject", "category"]).collect()}
    assert out == {"total_count": 0.0, "average_rating": None}


def test_null_dates_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, d int")
    assert [r["id"] for r in rows.latest(df, "d", "id").collect()] == [3, 2, 1]
    assert [r["id"] for r in rows.latest(df, "d", "id", ascending=True).collect()] == [2, 3, 1]


def test_updates_and_deletes(spark):
    base = spark.createDataFrame([("F000001", 1, "x"), ("F000002", 2, None)], "feedback_id string, rating int, category string")
    updates = spark.createDataFrame([("F000002", 5, "?"), ("F9", 1, "?")], "feedback_id string, rating int, extra string")
    out = {r["feedback_id"]: (r["rating"], r["category"]) for r in rows.update_rows(base, updates, "feedback_id").collect()}
    assert out == {"F000001": (1, "x"), "F000002": (5, None)}
    missing = rows.unknown_keys(base, updates, "feedback_id").collect()
    assert [(r["status"], r["message"]) for r in missing] == [("error", "Feedback with ID F9 not found")]
    assert [r[0] for r in rows.delete_rows(base, updates, "feedback_id").select("feedback_id").collect()] == ["F000001"]


def test_append_goes_on_from_highest_id(spark):
    existing = spark.createDataFrame([("F000007", "s", "t")], "feedback_id string, student_id string, feedback_text string")
    existing = existing.withColumn("date", F.lit("2024-01-01").cast("date"))
    new = spark.createDataFrame([("hello", ""), ("again", "S1")], "feedback_text string, student_id string")
    out = {r["feedback_id"]: (r["student_id"], r["feedback_text"]) for r in rows.append_feedback(existing, new, ["feedback_text"], "2024-02-02").collect()}
    assert out == {"F000007": ("s", "t"), "F000008": ("S1", "again"), "F000009": ("anonymous", "hello")}


def test_numbering(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    out = number_rows(df, ["k"], start=5).collect()
    assert all(r["id"] == r["k"] + 5 for r in out) and len(out) == 1000
    loose = number_rows(df, [], start=0).collect()
    assert sorted(r["id"] for r in loose) == list(range(1000))
    groups = df.select("k", F.when(F.col("k") < 800, "hot").otherwise("cold").alias("g"))
    ranks = rank_in_groups(groups, "g", "k", slices=8).groupBy("g").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert {r["g"]: r["r"] == list(range(len(r["r"]))) for r in ranks} == {"hot": True, "cold": True}
    by_slices = [{tuple(r) for r in rank_in_groups(groups, "g", "k", slices=n).collect()} for n in (1, 64, 70)]
    assert by_slices[0] == by_slices[1] == by_slices[2]


def test_last_update_wins(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    updates = spark.createDataFrame([(1, "c", 7), (1, None, 8), (3, "z", 9)], "k int, x string, other int").coalesce(1)
    assert sorted(map(tuple, rows.update_rows(base, updates, "k").collect())) == [(1, None, 1), (2, "b", 2)]


def test_ids_without_digits(spark):
    existing = spark.createDataFrame([("F000007", "t"), ("manual", "u")], "feedback_id string, feedback_text string")
    existing = existing.withColumn("date", F.lit("2024-01-01").cast("date"))
    out = rows.append_feedback(existing, spark.createDataFrame([("v", "")], "feedback_text string, student_id string"), ["feedback_text"], "2024-02-02")
    assert {r["feedback_id"] for r in out.collect()} == {"F000007", "manual", "F000008"}


def test_too_many_labels(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("r"), F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        stats.crosstab(df, "r", "c")


def test_split_is_stable(spark):
    df = spark.range(5000)
    train, test = rows.split_rows(df, "id")
    again, _ = rows.split_rows(df.repartition(13), "id")
    assert {r[0] for r in train.collect()} == {r[0] for r in again.collect()}
    assert train.count() + test.count() == 5000 and 3300 < train.count() < 3700


def test_store(spark):
    store = Store(spark, scratch_path(spark, "store"))
    store.create_tables()
    store.create_tables()  # keeps what is there
    given = spark.createDataFrame([(1, "same"), (2, "other"), (3, "same")], "n int, feedback_text string")
    assert store.import_feedback(given, ["n"], "2024-05-05") == 3
    results = spark.createDataFrame([("same", "Positive"), ("same", "Neutral"), ("unknown", "Negative")], "text string, predicted_sentiment string")
    assert store.store_sentiment(results, "m") == 2
    found = store.sentiment().collect()
    assert {(r["id"], r["sentiment"], r["confidence"]) for r in found} == {(3, "Positive", 0.0), (3, "Neutral", 0.0)}
    words = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "topic int, words array<string>")
    assert store.store_topics(words, "m") == 1 and store.store_topics(words, "m") == 3
    shares = spark.createDataFrame([("other", [0.25, 0.75])], "text string, probabilities array<double>")
    assert store.store_topic_analysis(shares, "m", 3) == 2
    top = store.topics(1).first()
    assert (top["id"], top["topic_name"], top["top_words"], top["probability"]) == (2, "Topic 2", "c", 0.75)
    assert store.query("SELECT count(*) FROM feedback").first()[0] == 3
    assert known_texts(store.table("feedback"), results).count() == 2
    with pytest.raises(ValueError):
        store.import_feedback(given.drop("feedback_text"), ["n"], "2024-05-05")
    with pytest.raises(ValueError):
        label_rows(results, store.table("feedback"), "category", "m")
    with pytest.raises(ValueError):
        require_columns(given, ["x"])


def test_files(spark):
    path = scratch_path(spark, "csv")
    made = files.generate_sample(spark, 200, "2024-06-30")
    files.write_csv(made, path)
    back = files.read_csv(spark, path)
    assert back.exceptAll(made).count() == 0 and back.count() == 200
    for label, (low, high) in files.RATINGS.items():
        assert made.where((F.col("true_sentiment") == label) & ~F.col("rating").between(low, high)).count() == 0
    bounds = made.agg(F.min("date"), F.max("date")).first()
    assert dt.date(2023, 7, 1) <= bounds[0] and bounds[1] <= dt.date(2024, 6, 30)
    shares = {r["true_sentiment"]: r["count"] for r in files.generate_sample(spark, 20_000, "2024-06-30").groupBy("true_sentiment").count().collect()}
    assert abs(shares["Positive"] - 12_000) < 400 and abs(shares["Negative"] - 3000) < 300
    tricky = spark.createDataFrame([(' say "hi",\nnew line ', 3)], "feedback_text string, rating int")
    tricky = tricky.select(*[(F.col(f.name) if f.name in tricky.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in files.FEEDBACK.fields])
    path = scratch_path(spark, "tricky")
    files.write_csv(tricky, path)
    assert files.read_csv(spark, path).first()["feedback_text"] == ' say "hi",\nnew line '


def test_three_class_metrics(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(pairs, "t string, p string")
    report = {r["label"]: r for r in metrics.class_report(df, "t", "p").collect()}
    assert (report["a"]["precision"], report["a"]["recall"], report["a"]["support"]) == (0.75, 0.75, 4)
    assert (report["c"]["precision"], report["c"]["recall"], report["c"]["f1"]) == (0.0, 0.0, 0.0)
    score = metrics.scores(df, "t", "p").first()
    assert score["accuracy"] == pytest.approx(5 / 7)
    assert score["f1_macro"] == pytest.approx((0.75 + 0.8 + 0) / 3)
    assert score["f1_weighted"] == pytest.approx((0.75 * 4 + 0.8 * 2) / 7)
    cells = {(r[0], r[1]): r[2] for r in metrics.confusion_matrix(df, "t", "p").collect()}
    assert len(cells) == 9 and cells["c", "a"] == 1 and cells["c", "c"] == 0


def test_sketch_is_not_kept_per_student(spark, data):
    """The exact and the approximate count are two aggregations: together, each student would have a sketch."""
    from voxtide.plans.invariant_queries import approximate_count_is_close

    plan = approximate_count_is_close(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    sketched = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketched and not any("count(distinct" in line or "gid" in line for line in sketched)
