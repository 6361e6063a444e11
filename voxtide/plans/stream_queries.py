"""Queries that run as streams over the files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide.functions.lexicon import score_sentiment
from voxtide.operators.classify import Scorer
from voxtide.plans.model_queries import _bayes, _vocabulary
from voxtide.plans.registry import QUERIES, query, rounded
from voxtide.plans.store_queries import LEXICON, NEGATIVE, POSITIVE
from voxtide.session import scratch_path
from voxtide.sources.tables import table
from voxtide.streaming import ingest


def _stream(spark, folder, name):
    return ingest.stream_table(spark, folder, name, table(spark, folder, name).schema)


@query("stream_collection", "ST1 P9", """
SELECT event_id, 'S' || user_id AS student_id, 'unknown' AS course_id, event_type AS subject, value FROM events""")
def stream_collection(spark, folder):
    events = _stream(spark, folder, "events").select(
        "event_id", F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("student_id"),
        F.col("event_type").alias("subject"), "value", "ts",
    )
    stored = ingest.run_available(ingest.collect_submissions(events, ["event_id"], "ts"), "collection")
    return stored.select("event_id", "student_id", "course_id", "subject", "value")


@query("stream_late_repeats", "ST1", """
SELECT event_id, 'S' || user_id AS student_id, event_type AS subject, value, CAST(ts AS DATE) AS date FROM events""")
def stream_late_repeats(spark, folder):
    """All events arrive, and ten days later all of them again: each is stored once, as it came first."""
    events = _stream(spark, folder, "events").select(
        "event_id", F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("student_id"), F.col("event_type").alias("subject"), "value", "ts",
    )
    late = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    kept = scratch_path(spark, "submissions")
    for source, arriving in (("form", events), ("again", late)):
        ingest.collect_once(arriving, ["event_id"], "ts", kept, scratch_path(spark, f"{source}-progress"), source)
    return ingest.collected(spark, kept).select("event_id", "student_id", "subject", "value", F.col("ts").cast("date").alias("date"))


@query("stream_volume", "ST2", """
WITH d AS (SELECT CAST(ts AS DATE) AS period, event_type, count(*) AS count, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2)
SELECT * FROM d WHERE period + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_volume(spark, folder):
    events = _stream(spark, folder, "events").select("ts", "event_type", "value")
    daily = ingest.volume_per_day(events, "ts", "value", ["event_type"])
    return rounded(ingest.run_available(daily, "volume"), "mean")


@query("stream_scoring", "ST3 N1", f"WITH {LEXICON} SELECT doc_id, predicted_sentiment, round(confidence, 6) AS confidence FROM scored")
def stream_scoring(spark, folder):
    docs = _stream(spark, folder, "documents").select("doc_id", "text")
    scored = ingest.score_stream(docs, lambda df: score_sentiment(df, "text", POSITIVE, NEGATIVE).drop("text"))
    return rounded(ingest.run_available(scored, "scored"), "confidence")


@query("stream_scoring_fitted", "ST3 M10", QUERIES["score_new_feedback"].sql)
def stream_scoring_fitted(spark, folder):
    """Submissions scored on arrival with the fitted vocabulary and model: the same as in a batch."""
    scorer = Scorer(_vocabulary(spark, folder, "count"), {"category": _bayes(spark, folder)})
    talk = _stream(spark, folder, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    return ingest.score_new(talk, lambda rows: scorer(rows, "id", "text"), "categories")
