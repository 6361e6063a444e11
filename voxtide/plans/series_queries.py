"""Queries on calendar series."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide.functions import dates
from voxtide.operators import series
from voxtide.plans.registry import query, rounded
from voxtide.sources.tables import FEEDBACK_SQL, feedback_from_orders, table

WITH_FB = "WITH " + FEEDBACK_SQL
CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SENTIMENTS = ["Negative", "Neutral", "Positive"]
WINDOW, THRESHOLD = 6, 2.0

UNIT_STEP = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}


def end_sql(start: str, unit: str) -> str:
    return f"CAST({start} + INTERVAL {UNIT_STEP[unit]} - INTERVAL 1 DAY AS DATE)"


def label_sql(date: str, unit: str) -> str:
    return end_sql(f"date_trunc('{unit}', {date})", unit)


def dense_sql(unit: str, source: str, date: str, aggregates: str, filled: str) -> str:
    """CTEs `s` (occurring periods), `cal` (all periods) and the dense selection."""
    return f"""s AS (SELECT date_trunc('{unit}', {date}) AS start, {aggregates} FROM {source} GROUP BY 1),
cal AS (SELECT unnest(generate_series(min(start), max(start), INTERVAL {UNIT_STEP[unit]})) AS start FROM s),
dense AS (SELECT {end_sql('cal.start', unit)} AS period, {filled} FROM cal LEFT JOIN s ON s.start = cal.start)"""


VOLUME = "coalesce(count, 0) AS count"


@query("period_labels", "T1", WITH_FB + f"""
SELECT id, {label_sql('date', 'day')} AS day, {label_sql('date', 'week')} AS week, {label_sql('date', 'month')} AS month,
       {label_sql('date', 'quarter')} AS quarter, {label_sql('date', 'year')} AS year FROM fb""")
def period_labels(spark, folder):
    fb = feedback_from_orders(spark, folder)
    names = {"day": "D", "week": "W", "month": "M", "quarter": "Q", "year": "Y"}
    return fb.select("id", *[dates.period_end(F.col("date"), f).alias(n) for n, f in names.items()])


@query("dense_calendar", "T2", WITH_FB + f""", b AS (SELECT date_trunc('week', min(date)) AS lo, date_trunc('week', max(date)) AS hi FROM fb),
c AS (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS start FROM b) SELECT {end_sql('start', 'week')} AS period FROM c""")
def dense_calendar(spark, folder):
    start = dates.period_start(F.col("date"), "W")
    bounds = feedback_from_orders(spark, folder).agg(F.min(start).alias("lo"), F.max(start).alias("hi"))
    return dates.calendar(bounds, "lo", "hi", "W").select(dates.end_of_period(F.col("start"), "W").alias("period"))


def _volume_query(freq: str, unit: str) -> None:
    sql = f"{WITH_FB}, {dense_sql(unit, 'fb', 'date', 'count(*) AS count', VOLUME)} SELECT * FROM dense"

    @query(f"volume_by_{unit}", "T3", sql)
    def run(spark, folder):
        return series.volume(feedback_from_orders(spark, folder), freq=freq)


for _unit, _freq in (("day", "D"), ("week", "W"), ("month", "M"), ("quarter", "Q"), ("year", "Y")):
    _volume_query(_freq, _unit)


@query("sparse_volume", "T3", f"""
WITH every AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders),
{dense_sql('day', 'every', 'date', 'count(*) AS count', VOLUME)} SELECT * FROM dense""")
def sparse_volume(spark, folder):
    return series.volume(feedback_from_orders(spark, folder), freq="D")


def _column_query(how: str):
    agg = {"count": "count(rating)", "mean": "avg(rating)", "sum": "CAST(coalesce(sum(rating), 0) AS BIGINT)"}[how]
    fill = "round(v, 6)" if how == "mean" else "coalesce(v, 0)"
    sql = f"""WITH every AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(1 + least(4, floor(o_totalprice / 100000)) AS INTEGER) AS rating
  FROM orders),
{dense_sql('week', 'every', 'date', f'{agg} AS v', f'{fill} AS rating')} SELECT * FROM dense"""

    @query(f"rating_{how}_by_week", "T4", sql)
    def run(spark, folder):
        out = series.column_series(feedback_from_orders(spark, folder), "rating", how, freq="W")
        return rounded(out, "rating") if how == "mean" else out


for _how in ("count", "mean", "sum"):
    _column_query(_how)

_SHARES = ", ".join(
    [f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}" for s in SENTIMENTS]
    + [f"round(100.0 * count(*) FILTER (WHERE sentiment = '{s}') / count(*), 6) AS {s}_pct" for s in SENTIMENTS]
)


@query("sentiment_trend", "T5", f"{WITH_FB} SELECT {label_sql('date', 'month')} AS period, {_SHARES} FROM fb GROUP BY 1")
def sentiment_trend(spark, folder):
    out = series.label_trend(feedback_from_orders(spark, folder), "sentiment", freq="M")
    return rounded(out, *[f"{s}_pct" for s in SENTIMENTS])


_CATEGORY_COUNTS = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS \"{c}\"" for c in CATEGORIES)


@query("category_trend", "T6", f"{WITH_FB} SELECT {label_sql('date', 'quarter')} AS period, {_CATEGORY_COUNTS} FROM fb GROUP BY 1")
def category_trend(spark, folder):
    return series.label_trend(feedback_from_orders(spark, folder), "category", freq="Q", percent=False)


@query("category_heat_map", "T7", WITH_FB + f""", p AS (SELECT {label_sql('date', 'month')} AS period, category, count(*) AS n FROM fb GROUP BY ALL)
SELECT a.period, b.category, coalesce(n, 0) AS count FROM (SELECT DISTINCT period FROM p) a
CROSS JOIN (SELECT DISTINCT category FROM p) b LEFT JOIN p ON p.period = a.period AND p.category = b.category""")
def category_heat_map(spark, folder):
    return series.label_matrix(feedback_from_orders(spark, folder), "category", freq="M")


_RATING = dense_sql(
    "month", "fb", "date", "avg(rating) AS mean, count(rating) AS count, stddev_samp(rating) AS std",
    "mean, coalesce(count, 0) AS count, std",
)


@query("rating_trend", "T8 J7", f"{WITH_FB}, {_RATING} SELECT period, round(mean, 6) AS mean, count, round(std, 6) AS std FROM dense")
def rating_trend(spark, folder):
    return rounded(series.rating_trend(feedback_from_orders(spark, folder)), "mean", "std")


@query("rating_band", "T9", f"""{WITH_FB}, {_RATING} SELECT period, round(mean, 6) AS mean, count, round(std, 6) AS std,
  round(mean + std, 6) AS upper, round(mean - std, 6) AS lower FROM dense""")
def rating_band(spark, folder):
    out = series.with_band(series.rating_trend(feedback_from_orders(spark, folder)))
    return rounded(out, "mean", "std", "upper", "lower")


def _combined_sql() -> str:
    top = "(SELECT category FROM fb GROUP BY category ORDER BY count(*) DESC, category LIMIT 1 OFFSET {})"
    cats = ", ".join(f"count(*) FILTER (WHERE category = {top.format(i)}) AS c{i}" for i in range(3))
    sents = ", ".join(f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}" for s in SENTIMENTS)
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["feedback_count", *SENTIMENTS, "c0", "c1", "c2"])
    dense = dense_sql(
        "month", "fb", "date", f"count(*) AS feedback_count, avg(rating) AS avg_rating, {sents}, {cats}",
        f"{filled}, round(avg_rating, 6) AS avg_rating",
    )
    long = "unnest([{}]) AS series, unnest([{}]) AS value"
    fixed = ["feedback_count", *SENTIMENTS]
    names = [f"'{c}'" for c in fixed] + [f"'category_' || replace({top.format(i)}, ' ', '_')" for i in range(3)]
    values = [*fixed, "c0", "c1", "c2"]
    return (
        f"{WITH_FB}, {dense} SELECT period, {long.format(', '.join(names), ', '.join(f'CAST({v} AS DOUBLE)' for v in values))} FROM dense "
        "UNION ALL SELECT period, 'avg_rating', avg_rating FROM dense"
    )


@query("combined_series", "T10 J7", _combined_sql())
def combined_series(spark, folder):
    fb = feedback_from_orders(spark, folder).withColumnsRenamed({"sentiment": "true_sentiment", "category": "true_category"})
    wide = series.combined_series(fb)
    doubles = wide.select("period", *[F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns if c != "period"])
    return rounded(doubles.unpivot(["period"], doubles.columns[1:], "series", "value"), "value")


def rolling_sql(part: str = "") -> str:
    over = f"OVER ({part} ORDER BY period ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)"
    return f"""r AS (SELECT *, CASE WHEN count(*) {over} = {WINDOW} THEN avg(count) {over} END AS m,
  CASE WHEN count(*) {over} = {WINDOW} THEN stddev_samp(count) {over} END AS sd FROM dense)"""


_MONTHLY = dense_sql("month", "fb", "date", "count(*) AS count", VOLUME)
_BOUNDS = f"round(m, 6) AS rolling_mean, round(m + {THRESHOLD} * sd, 6) AS upper_bound, round(m - {THRESHOLD} * sd, 6) AS lower_bound"
_SIGN = f"CASE WHEN count > m + {THRESHOLD} * sd THEN 1 WHEN count < m - {THRESHOLD} * sd THEN -1 ELSE 0 END"


@query("anomalies_signed", "T11 W1 W2", f"{WITH_FB}, {_MONTHLY}, {rolling_sql()} SELECT period, count, {_BOUNDS}, {_SIGN} AS anomaly FROM r")
def anomalies_signed(spark, folder):
    monthly = series.volume(feedback_from_orders(spark, folder))
    out = series.detect_anomalies(monthly, "count", WINDOW, THRESHOLD)
    return rounded(out, "rolling_mean", "upper_bound", "lower_bound")


@query("anomalies_boolean", "T12", f"{WITH_FB}, {_MONTHLY}, {rolling_sql()} SELECT period, count, {_BOUNDS}, {_SIGN} <> 0 AS anomaly FROM r")
def anomalies_boolean(spark, folder):
    monthly = series.volume(feedback_from_orders(spark, folder))
    out = series.detect_anomalies(monthly, "count", WINDOW, THRESHOLD, signed=False)
    return rounded(out, "rolling_mean", "upper_bound", "lower_bound")


@query("anomaly_table", "T13", f"""{WITH_FB}, {_MONTHLY}, {rolling_sql()}
SELECT period, count, CASE WHEN {_SIGN} = 1 THEN 'High Volume' ELSE 'Low Volume' END AS anomaly_type
FROM r WHERE {_SIGN} <> 0 AND (SELECT count(*) FROM r) > 5""")
def anomaly_table(spark, folder):
    monthly = series.volume(feedback_from_orders(spark, folder))
    return series.anomaly_table(series.detect_anomalies(monthly, "count", WINDOW, THRESHOLD))


@query("rating_volume_correlation", "T14 A16 A17", f"""{WITH_FB}, {_RATING}, c AS (SELECT corr(mean, count) AS r FROM dense)
SELECT round(r, 6) AS correlation, CASE WHEN r > 0.5 THEN 'positive' WHEN r < -0.5 THEN 'negative' ELSE 'no strong correlation' END AS strength
FROM c WHERE (SELECT count(*) FROM dense) > 5""")
def rating_volume_correlation(spark, folder):
    trend = series.rating_trend(feedback_from_orders(spark, folder))
    return rounded(series.rating_volume_correlation(trend), "correlation")


_KEYED = f"""s AS (SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL),
cal AS (SELECT event_type, unnest(generate_series(min(start), max(start), INTERVAL 1 DAY)) AS start FROM s GROUP BY event_type),
dense AS (SELECT cal.event_type, CAST(cal.start AS DATE) AS period, coalesce(n, 0) AS count
  FROM cal LEFT JOIN s ON s.start = cal.start AND s.event_type = cal.event_type)"""


@query("anomalies_per_key", "T15 T11 T3", f"""WITH {_KEYED}, {rolling_sql('PARTITION BY event_type')}
SELECT event_type, period, count, {_BOUNDS}, {_SIGN} AS anomaly FROM r""")
def anomalies_per_key(spark, folder):
    events = table(spark, folder, "events").select("event_type", F.col("ts").cast("date").alias("date"))
    daily = series.volume(events, freq="D", keys=["event_type"])
    out = series.detect_anomalies(daily, "count", WINDOW, THRESHOLD, keys=["event_type"])
    return rounded(out, "rolling_mean", "upper_bound", "lower_bound")


@query("rating_trend_per_key", "T15 T8", WITH_FB + f""", s AS (SELECT subject, date_trunc('month', date) AS start, avg(rating) AS mean,
  count(rating) AS count, stddev_samp(rating) AS std FROM fb GROUP BY ALL),
cal AS (SELECT subject, unnest(generate_series(min(start), max(start), INTERVAL 1 MONTH)) AS start FROM s GROUP BY subject)
SELECT cal.subject, {end_sql('cal.start', 'month')} AS period, round(mean, 6) AS mean, coalesce(count, 0) AS count, round(std, 6) AS std
FROM cal LEFT JOIN s ON s.start = cal.start AND s.subject = cal.subject""")
def rating_trend_per_key(spark, folder):
    fb = feedback_from_orders(spark, folder, subject=True)
    return rounded(series.rating_trend(fb, keys=["subject"]), "mean", "std")


@query("flagship", "T2 T3 T8 T11", f"""{WITH_FB}, {_RATING}, {rolling_sql()}
SELECT period, count, round(mean, 6) AS mean, {_BOUNDS}, {_SIGN} AS anomaly FROM r""")
def flagship(spark, folder):
    trend = series.rating_trend(feedback_from_orders(spark, folder)).select("period", "count", "mean")
    out = series.detect_anomalies(trend, "count", WINDOW, THRESHOLD)
    return rounded(out, "mean", "rolling_mean", "upper_bound", "lower_bound")
