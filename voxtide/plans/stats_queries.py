"""Queries on counts, shares, cross-tabulations and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide.functions.text import drop_stop_words, split_words, clean, STOP_WORDS
from voxtide.operators import stats
from voxtide.plans.registry import query, rounded, sql_list
from voxtide.sources.tables import FEEDBACK_SQL, feedback_from_orders, labelled_documents, table

WITH_FB = "WITH " + FEEDBACK_SQL
SENTIMENTS = ["Negative", "Neutral", "Positive"]

# Words of a cleaned text in SQL; the quoted characters are the ASCII punctuation.
WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')),
  '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '[\s\p{Z}]+'), lambda t: t <> '')"""
KEPT_WORDS_SQL = f"list_filter({WORDS_SQL}, lambda t: t NOT IN ({sql_list(STOP_WORDS)}))"


@query("value_counts", "A1", WITH_FB + " SELECT subject, count(*) AS count FROM fb GROUP BY subject")
def value_counts(spark, folder):
    return stats.value_counts(feedback_from_orders(spark, folder, subject=True), "subject")


@query("value_shares", "A2", """
SELECT quality, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent
FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY quality""")
def value_shares(spark, folder):
    return rounded(stats.value_shares(labelled_documents(spark, folder), "quality"), "percent")


@query("rating_counts", "A3", WITH_FB + " SELECT rating, count(*) AS count FROM fb GROUP BY rating ORDER BY rating")
def rating_counts(spark, folder):
    return stats.counts_by_key(feedback_from_orders(spark, folder), "rating")


@query("collection_stats", "A4", WITH_FB + """
SELECT 'total_count' AS metric, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM fb UNION ALL
SELECT 'average_rating', NULL, round(avg(rating), 6) FROM fb UNION ALL
SELECT 'subject_counts', subject, count(*) FROM fb WHERE subject IS NOT NULL GROUP BY subject UNION ALL
SELECT 'category_counts', category, count(*) FROM fb GROUP BY category UNION ALL
SELECT 'sentiment_counts', sentiment, count(*) FROM fb GROUP BY sentiment""")
def collection_stats(spark, folder):
    fb = feedback_from_orders(spark, folder, subject=True)
    return rounded(stats.collection_stats(fb, "rating", ["subject", "category", "sentiment"]), "value")


@query("positive_share", "A5", WITH_FB + """
SELECT round(100.0 * count(*) FILTER (WHERE sentiment = 'Positive') / count(*), 6) AS positive_pct FROM fb""")
def positive_share(spark, folder):
    fb = feedback_from_orders(spark, folder)
    return rounded(stats.label_share(fb, "sentiment", "Positive", "positive_pct"), "positive_pct")


@query("distinct_students", "A6", WITH_FB + " SELECT count(DISTINCT student) AS distinct_values FROM fb")
def distinct_students(spark, folder):
    return stats.distinct_count(feedback_from_orders(spark, folder), "student")


@query("approximate_distinct_students", "A6")
def approximate_distinct_students(spark, folder):
    return stats.distinct_count(feedback_from_orders(spark, folder), "student", approximate=True)


def _describe_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
  round(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM fb"""


@query("describe", "A7", WITH_FB + " " + _describe_sql("rating") + " UNION ALL " + _describe_sql("amount"))
def describe(spark, folder):
    out = stats.describe(feedback_from_orders(spark, folder), ["rating", "amount"])
    return rounded(out, "mean", "std", "p25", "p50", "p75", digits=4)


def _crosstab_sql(fraction: bool) -> str:
    cells = []
    for v in SENTIMENTS:
        n = f"count(*) FILTER (WHERE sentiment = '{v}')"
        cells.append(f"round({n} / count(*), 6) AS {v}" if fraction else f"{n} AS {v}")
    return f"{WITH_FB} SELECT category, {', '.join(cells)} FROM fb GROUP BY category"


@query("crosstab", "A8", _crosstab_sql(False))
def crosstab(spark, folder):
    return stats.crosstab(feedback_from_orders(spark, folder), "category", "sentiment")


@query("crosstab_fractions", "A9", _crosstab_sql(True))
def crosstab_fractions(spark, folder):
    out = stats.crosstab_fractions(feedback_from_orders(spark, folder), "category", "sentiment")
    return rounded(out, *SENTIMENTS)


@query("crosstab_long", "A10", WITH_FB + """
SELECT category, s.sentiment, round(count(*) FILTER (WHERE fb.sentiment = s.sentiment) / count(*), 6) AS value
FROM fb, (SELECT DISTINCT sentiment FROM fb) s GROUP BY ALL""")
def crosstab_long(spark, folder):
    wide = stats.crosstab_fractions(feedback_from_orders(spark, folder), "category", "sentiment")
    return rounded(stats.melt(wide, ["category"], "sentiment"), "value")


@query("rating_by_sentiment", "A11", WITH_FB + " SELECT rating, sentiment, count(*) AS count FROM fb GROUP BY ALL")
def rating_by_sentiment(spark, folder):
    return stats.pair_counts(feedback_from_orders(spark, folder), "rating", "sentiment")


@query("histogram", "A12", """
WITH x AS (SELECT len(list_filter(range(0, 20), lambda i: i * CAST(0.005 AS DOUBLE) <= l_discount)) AS b
  FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1)
SELECT CAST(b AS INTEGER) AS bin, CAST(round((b - 1) * 0.005, 6) AS DOUBLE) AS bin_from, CAST(round(b * 0.005, 6) AS DOUBLE) AS bin_to, count(*) AS count FROM x GROUP BY ALL""")
def histogram(spark, folder):
    out = stats.histogram(table(spark, folder, "lineitem").select("l_discount"), "l_discount", 0, 0.1, 20)
    return rounded(out, "bin_from", "bin_to")


@query("rating_histogram", "A12", WITH_FB + """
SELECT CAST(least(floor((rating - 1) / 0.8) + 1, 5) AS INTEGER) AS bin,
       CAST(round(1 + (bin - 1) * 0.8, 6) AS DOUBLE) AS bin_from, CAST(round(1 + bin * 0.8, 6) AS DOUBLE) AS bin_to, count(*) AS count FROM fb GROUP BY ALL""")
def rating_histogram(spark, folder):
    return rounded(stats.histogram(feedback_from_orders(spark, folder), "rating", 1, 5, 5), "bin_from", "bin_to")


def _box_sql(source: str, g: str, v: str) -> str:
    return f"""
WITH {source}, q AS (
  SELECT {g}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3 FROM src GROUP BY {g}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT {g}, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3,
       CAST(min({v}) FILTER (WHERE {v} BETWEEN lo AND hi) AS DOUBLE) AS whisker_low,
       CAST(max({v}) FILTER (WHERE {v} BETWEEN lo AND hi) AS DOUBLE) AS whisker_high,
       count(*) FILTER (WHERE {v} NOT BETWEEN lo AND hi) AS outliers
FROM src JOIN f USING ({g}) GROUP BY {g}, q1, q2, q3"""


@query("rating_box_plot", "A13", _box_sql(FEEDBACK_SQL + ", src AS (SELECT sentiment, rating FROM fb)", "sentiment", "rating"))
def rating_box_plot(spark, folder):
    return rounded(stats.box_stats(feedback_from_orders(spark, folder), "sentiment", "rating"), "q1", "q2", "q3", digits=4)


@query("value_box_plot", "A13", _box_sql("src AS (SELECT event_type, value FROM events)", "event_type", "value"))
def value_box_plot(spark, folder):
    return rounded(stats.box_stats(table(spark, folder, "events"), "event_type", "value"), "q1", "q2", "q3", digits=4)


@query("top_categories", "A14", WITH_FB + """
SELECT category, count(*) AS count FROM fb GROUP BY category ORDER BY count DESC, category LIMIT 3""")
def top_categories(spark, folder):
    return stats.value_counts(feedback_from_orders(spark, folder), "category", 3)


@query("date_bounds", "A15", WITH_FB + " SELECT min(date) AS first_date, max(date) AS last_date FROM fb")
def date_bounds(spark, folder):
    return stats.date_bounds(feedback_from_orders(spark, folder), "date")


@query("correlation", "A16 A17", """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT round(r, 6) AS correlation, CASE WHEN r > 0.5 THEN 'positive' WHEN r < -0.5 THEN 'negative' ELSE 'no strong correlation' END AS strength FROM c""")
def correlation(spark, folder):
    return rounded(stats.correlation(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), "correlation")


@query("word_frequencies", "A18 X1 X2 X3 X4", f"""
SELECT word, count(*) AS count FROM (SELECT unnest({KEPT_WORDS_SQL}) AS word FROM documents)
GROUP BY word ORDER BY count DESC, word LIMIT 200""")
def word_frequencies(spark, folder):
    docs = table(spark, folder, "documents").select("text")
    return stats.word_counts(docs, drop_stop_words(split_words(clean(F.col("text")))))


@query("word_frequencies_by_language", "A19 L5", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY count DESC, word) AS INTEGER) AS rank FROM (
  SELECT lang, word, count(*) AS count FROM (SELECT lang, unnest({KEPT_WORDS_SQL}) AS word FROM documents) GROUP BY ALL)) WHERE rank <= 200""")
def word_frequencies_by_language(spark, folder):
    docs = table(spark, folder, "documents").select("lang", "text")
    return stats.word_counts_by(docs, "lang", drop_stop_words(split_words(clean(F.col("text")))))


@query("cluster_sizes", "A20 E9", "SELECT label, count(*) AS size FROM embeddings GROUP BY label")
def cluster_sizes(spark, folder):
    from voxtide.operators.clusters import sizes

    return sizes(table(spark, folder, "embeddings"), "label")
