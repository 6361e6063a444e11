"""Counts, shares, cross-tabulations, summaries, word frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.operators.quantiles import quantiles
from voxtide.operators.rows import first_per_group
from voxtide.session import materialize


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value; nulls are skipped."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).count()
    ordered = counted.orderBy(F.desc("count"), F.asc(column))
    return ordered if limit is None else ordered.limit(limit)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with their percentage of all rows (null rows count in the total)."""
    counted = df.groupBy(column).count()
    total = counted.agg(F.sum("count")).scalar()
    return (
        counted.where(F.col(column).isNotNull())
        .withColumn("percent", F.col("count") * 100.0 / total)
        .orderBy(F.desc("count"), F.asc(column))
    )


def counts_by_key(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(column)


def top_values(df: DataFrame, column: str, k: int) -> list:
    """The k most frequent values (k rows reach the driver)."""
    return [row[0] for row in value_counts(df, column, k).collect()]


MOST_LABELS = 1000  # columns of a wide table


def label_values(df: DataFrame, column: str) -> list:
    """The distinct labels of a column in order, each to become a column of a wide table.

    More than MOST_LABELS are refused; `pair_counts` has the same numbers in long form.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"{column} has more than {MOST_LABELS} labels: use the long form")
    return sorted(row[0] for row in rows)


def collection_stats(df: DataFrame, rating: str, labels: Sequence[str]) -> DataFrame:
    """Total, mean rating and counts per label column, as (metric, key, value) rows."""
    totals = df.agg(F.count(F.lit(1)).cast("double").alias("total_count"), F.avg(rating).alias("average_rating"))
    totals = totals.unpivot([], ["total_count", "average_rating"], "metric", "value")
    totals = totals.select("metric", F.lit(None).cast("string").alias("key"), "value")
    labels = [c for c in labels if c in df.columns]
    if not labels:
        return totals
    # One pass over the table for all label columns.
    sets = df.groupingSets([[c] for c in labels], *labels).agg(
        F.count(F.lit(1)).cast("double").alias("value"),
        *[F.grouping(c).alias(f"_{c}") for c in labels],
    )
    metric = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(f"{c}_counts")) for c in labels])
    key = F.coalesce(*[F.col(c).cast("string") for c in labels])
    counts = sets.select(metric.alias("metric"), key.alias("key"), "value").where(F.col("key").isNotNull())
    return totals.unionByName(counts)


def label_share(df: DataFrame, column: str, label: str, name: str = "percent") -> DataFrame:
    """Percentage of all rows that carry one label; 0 on an empty table."""
    hit = F.count_if(F.col(column) == label)
    return df.agg(F.coalesce(F.try_divide(hit * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias(name))


def distinct_count(df: DataFrame, column: str, approximate: bool = False, deviation: float = 0.01) -> DataFrame:
    """Distinct values; approximate counts have a relative standard deviation of `deviation`."""
    count = F.approx_count_distinct(column, deviation) if approximate else F.count_distinct(column)
    return df.agg(count.alias("distinct_values"))


SKETCH_BITS = 14  # the standard error of an estimate is at most 1.04 / sqrt(2 ** SKETCH_BITS)
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """A sketch of the distinct values per group, to be stored: (by..., sketch).

    Sketches add up: the distinct values of any set of groups come from the union of theirs, without
    the rows (see `distinct_from_sketches`). They are built before the shuffle, so a hot group is one
    sketch per task.
    """
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(column, SKETCH_BITS).alias("sketch"))


def distinct_from_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values per (coarser) group: (by..., distinct_values)."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column; nulls and NaN are no values."""
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]
    long = df.select(*clean).unpivot([], list(columns), "column_name", "v")  # all columns in one pass
    plain = long.groupBy("column_name").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    quartiles = quantiles(long, ["column_name"], "v", (0.25, 0.5, 0.75))
    both = plain.join(quartiles, "column_name", "left")
    return both.select(
        "column_name", "count", "mean", "std", "min", *[F.col("quantiles")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max"
    )


def crosstab(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Counts of row × column labels, wide, 0 where a pair does not occur."""
    values = label_values(df, column) if values is None else list(values)
    kept = df.where(F.col(row).isNotNull() & F.col(column).isin(values))
    return kept.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def crosstab_fractions(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Cross-tabulation with each row divided by its sum."""
    values = label_values(df, column) if values is None else list(values)
    counts = crosstab(df, row, column, values)
    total = sum((F.col(str(v)) for v in values), F.lit(0))
    return counts.select(row, *[(F.col(str(v)) / total).alias(str(v)) for v in values])


def melt(df: DataFrame, ids: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], name, value)


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).count()


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins from low to high; the upper edge belongs to the last bin."""
    x = F.col(column).cast("double")
    width = (high - low) / bins

    def edge(i: Column) -> Column:
        return F.lit(float(low)) + i * width

    guess = F.least(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)) - 1
    # Rounding may put a value on an edge one bin off: the edges decide.
    step = F.when(x < edge(guess), -1).when((x >= edge(guess + 1)) & (guess < bins - 1), 1).otherwise(0)
    counted = df.where(x.between(low, high)).groupBy((guess + step + 1).cast("int").alias("bin")).count()
    return counted.select(
        "bin", edge(F.col("bin") - 1).alias("bin_from"), edge(F.col("bin")).alias("bin_to"), "count"
    )


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outlier count per group."""
    # Written out so that the planner knows its size: few groups are broadcast to the
    # rows, many are joined by shuffle with hot groups split by the adaptive skew join.
    q = materialize(quantiles(df.where(F.col(group).isNotNull()), [group], column, (0.25, 0.5, 0.75)))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = q.select(
        group, *[F.col("quantiles")[i].alias(f"q{i + 1}") for i in range(3)]
    ).withColumns({"_lo": F.col("q1") - reach, "_hi": F.col("q3") + reach})
    v = F.col(column).cast("double")
    inside = v.between(F.col("_lo"), F.col("_hi"))
    return (
        df.select(group, column).where(F.col(column).isNotNull())
        .join(fences, group)
        .groupBy(group, "q1", "q2", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))


def strength(r: Column) -> Column:
    """Verbal label of a correlation coefficient."""
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r > 0.5, "positive").when(r < -0.5, "negative").otherwise("no strong correlation")
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation; rows with a null in either column are skipped."""
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b).alias("correlation"))
    return r.withColumn("strength", strength(F.col("correlation")))


def word_counts(df: DataFrame, tokens: Column, limit: int | None = 200) -> DataFrame:
    """Corpus frequencies of words, most frequent first."""
    words = df.select(F.explode(tokens).alias("word")).groupBy("word").count()
    ordered = words.orderBy(F.desc("count"), F.asc("word"))
    return ordered if limit is None else ordered.limit(limit)


def word_counts_by(df: DataFrame, group: str, tokens: Column, limit: int = 200) -> DataFrame:
    """Most frequent words of each group."""
    words = df.where(F.col(group).isNotNull()).select(group, F.explode(tokens).alias("word"))
    counted = words.groupBy(group, "word").count()
    return first_per_group(counted, group, [F.desc("count"), F.asc("word")], limit)
