"""Calendar roll-ups, rolling statistics and anomaly flags.

Raw rows meet one aggregation by period; everything after it (gap filling, rolling
windows) works on one row per period and, with `keys`, per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.functions.dates import STEP, end_of_period, period_start, unit_name
from voxtide.functions.text import column_label
from voxtide.operators.stats import label_values, strength, top_values


def per_period(
    df: DataFrame, date: str, freq: str, aggregates: dict[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """Aggregates per occurring period; column `start` is the period's first day."""
    dated = df.where(F.col(date).isNotNull())
    return dated.groupBy(*keys, period_start(F.col(date), freq).alias("start")).agg(
        *[expr.alias(name) for name, expr in aggregates.items()]
    )


def fill_gaps(
    series: DataFrame, freq: str, zero: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """Add the periods missing between the first and last one of each series.

    Each row is repeated up to the next occurring period; repeats hold 0 in the
    `zero` columns and null elsewhere. This needs no calendar join.
    """
    unit = unit_name(freq)
    order = W.partitionBy(*(keys or [F.lit(0)])).orderBy("start")
    following = F.lead("start").over(order)
    back = {"day": 1, "week": 7}.get(unit)
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    last = F.date_sub(following, back) if back else F.add_months(following, -months)
    steps = F.sequence(F.col("start"), F.coalesce(last, F.col("start")), F.expr(STEP[unit]))
    spread = series.withColumn("_steps", steps).select(
        *series.columns, F.posexplode("_steps").alias("_gap", "_start")
    )
    out = []
    for c in series.columns:
        if c == "start":
            out.append(F.col("_start").alias("start"))
        elif c in keys:
            out.append(F.col(c))
        else:
            empty = F.lit(0).cast(series.schema[c].dataType) if c in zero else F.lit(None)
            out.append(F.when(F.col("_gap") == 0, F.col(c)).otherwise(empty).alias(c))
    return spread.select(*out)


def labelled(series: DataFrame, freq: str, name: str = "period") -> DataFrame:
    """Replace `start` by the label of the period, its last day."""
    rest = [c for c in series.columns if c != "start"]
    return series.select(end_of_period(F.col("start"), freq).alias(name), *rest)


def volume(df: DataFrame, date: str = "date", freq: str = "M", keys: Sequence[str] = ()) -> DataFrame:
    """Rows per period; empty periods count 0."""
    counted = per_period(df, date, freq, {"count": F.count(F.lit(1))}, keys)
    return labelled(fill_gaps(counted, freq, ["count"], keys), freq)


def column_series(
    df: DataFrame, column: str | None = None, how: str = "count",
    date: str = "date", freq: str = "M", keys: Sequence[str] = (),
) -> DataFrame:
    """count, mean or sum of a column per period; without a column, the volume."""
    if column is None:
        return volume(df, date, freq, keys)
    makers = {"count": F.count, "mean": F.avg, "sum": F.sum}
    if how not in makers:
        raise ValueError(f"unknown aggregation function: {how}")
    # A sum over no values is 0, a mean over no values is null.
    value = F.coalesce(F.sum(column), F.lit(0)) if how == "sum" else makers[how](column)
    series = per_period(df, date, freq, {column: value}, keys)
    return labelled(fill_gaps(series, freq, [] if how == "mean" else [column], keys), freq)


def label_trend(
    df: DataFrame, label: str, values: Sequence[str] | None = None, date: str = "date",
    freq: str = "M", percent: bool = True, dense: bool = False, keys: Sequence[str] = (),
) -> DataFrame:
    """Counts per label and, if asked, percentages of the period; occurring periods only by default."""
    values = label_values(df, label) if values is None else list(values)
    kept = df.where(F.col(label).isin(values))
    counts = {str(v): F.count_if(F.col(label) == v) for v in values}
    series = per_period(kept, date, freq, counts, keys)
    if dense:
        series = fill_gaps(series, freq, list(counts), keys)
    if percent:
        total = sum((F.col(c) for c in counts), F.lit(0))
        series = series.withColumns({f"{c}_pct": F.try_divide(F.col(c) * 100.0, total) for c in counts})
    return labelled(series, freq)


def label_matrix(df: DataFrame, label: str, values: Sequence[str] | None = None,
                 date: str = "date", freq: str = "M") -> DataFrame:
    """Label × period counts in long form, 0 where a label is missing in a period."""
    wide = label_trend(df, label, values, date, freq, percent=False)
    return wide.unpivot(["period"], wide.columns[1:], label, "count")


def rating_trend(df: DataFrame, rating: str = "rating", date: str = "date", freq: str = "M",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Mean, count and sample deviation per period, dense."""
    series = per_period(
        df, date, freq,
        {"mean": F.avg(rating), "count": F.count(rating), "std": F.stddev_samp(rating)}, keys,
    )
    return labelled(fill_gaps(series, freq, ["count"], keys), freq)


def with_band(trend: DataFrame) -> DataFrame:
    """Mean plus and minus one deviation."""
    return trend.withColumns(
        {"upper": F.col("mean") + F.col("std"), "lower": F.col("mean") - F.col("std")}
    )


def combined_series(
    df: DataFrame, date: str = "date", freq: str = "month", rating: str = "rating",
    sentiment: str = "true_sentiment", category: str = "true_category", top: int = 3,
) -> DataFrame:
    """Volume, mean rating, counts per sentiment and per top category, one row per period."""
    aggregates = {"feedback_count": F.count(F.lit(1))}
    if rating in df.columns:
        aggregates["avg_rating"] = F.avg(rating)
    if sentiment in df.columns:
        for v in label_values(df, sentiment):
            aggregates[str(v)] = F.count_if(F.col(sentiment) == v)
    if category in df.columns:
        for v in top_values(df, category, top):
            aggregates[f"category_{column_label(str(v))}"] = F.count_if(F.col(category) == v)
    series = per_period(df, date, freq, aggregates)
    zero = [name for name in aggregates if name != "avg_rating"]
    return labelled(fill_gaps(series, freq, zero), freq)


def rolling(series: DataFrame, column: str, window: int, order: str = "period",
            keys: Sequence[str] = (), exclude_current: bool = False) -> DataFrame:
    """Rolling mean and sample deviation, null until the window is full."""
    last = -1 if exclude_current else 0
    frame = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(last - window + 1, last)
    full = F.count(column).over(frame) == window
    return series.withColumns(
        {
            "rolling_mean": F.when(full, F.avg(column).over(frame)),
            "rolling_std": F.when(full, F.stddev_samp(column).over(frame)),
        }
    )


def detect_anomalies(
    series: DataFrame, column: str, window: int = 3, threshold: float = 2.0, order: str = "period",
    keys: Sequence[str] = (), signed: bool = True, exclude_current: bool = False,
) -> DataFrame:
    """Flag values outside rolling mean ± threshold · rolling deviation.

    Signed flags are 1, −1 and 0; otherwise the flag is a boolean. The window holds
    the current value unless `exclude_current` is set; with small windows it can
    then never be an outlier.
    """
    rolled = rolling(series, column, window, order, keys, exclude_current)
    spread = F.col("rolling_std") * threshold
    bounded = rolled.withColumns(
        {"upper_bound": F.col("rolling_mean") + spread, "lower_bound": F.col("rolling_mean") - spread}
    ).drop("rolling_std")
    value = F.col(column)
    high, low = value > F.col("upper_bound"), value < F.col("lower_bound")
    flag = F.when(high, 1).when(low, -1).otherwise(0) if signed else F.coalesce(high | low, F.lit(False))
    return bounded.withColumn("anomaly", flag)


def _enough(series: DataFrame, periods: int) -> DataFrame:
    """The series if it is longer than `periods`, else nothing."""
    counted = series.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    return counted.where(F.col("_n") > periods).drop("_n")


def anomaly_table(flagged: DataFrame, column: str = "count", more_than: int = 5) -> DataFrame:
    """Flagged periods with a verbal type; empty for series of at most `more_than` periods."""
    kind = F.when(F.col("anomaly") == 1, "High Volume").otherwise("Low Volume")
    return _enough(flagged, more_than).where(F.col("anomaly") != 0).select(
        "period", column, kind.alias("anomaly_type")
    )


def rating_volume_correlation(trend: DataFrame, more_than: int = 5) -> DataFrame:
    """Correlation of mean rating and volume over periods, if there are enough of them."""
    pairs = _enough(trend, more_than).where(F.col("mean").isNotNull())
    r = pairs.groupBy().agg(F.corr("mean", F.col("count").cast("double")).alias("correlation"),
                            F.count(F.lit(1)).alias("periods"))
    return r.where(F.col("periods") > 0).select("correlation", strength(F.col("correlation")).alias("strength"))
