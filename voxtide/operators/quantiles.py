"""Exact quantiles (linear interpolation) of columns of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.session import materialize


def quantiles(df: DataFrame, groups: Sequence[str], column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row per group with the array column `quantiles`; nulls and NaN are no values.

    Equal values are counted before they are shuffled. The counted values are then sorted
    over all tasks by (group, value), so a group may span many tasks; counting per group
    and task tells which task holds each wanted rank, and only those tasks' rows are looked
    at value by value.
    """
    groups, probabilities = list(groups), list(probabilities)
    v = F.col(column).cast("double")
    values = df.select(*groups, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counted = values.groupBy(*groups, "v").agg(F.count("*").alias("m"))
    cut = materialize(counted.orderBy(*groups, "v").withColumn("part", F.spark_partition_id()), "values")
    sizes = cut.groupBy(*groups, "part").agg(F.sum("m").alias("n"))

    # `sizes` has a row per group and task that holds some of it, so windows per group are small.
    by_group = W.partitionBy(*(groups or [F.lit(0)]))
    upto = by_group.orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    located = sizes.withColumns(
        {"total": F.sum("n").over(by_group), "below": F.sum("n").over(upto) - F.col("n")}
    )
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), ((F.col("total") - 1) * p).alias("at"))
            for i, p in enumerate(probabilities)
        ]
    )
    targets = located.select(*groups, "part", "below", "n", F.explode(wanted).alias("t")).select(
        *groups, "part", "below", "n", F.col("t.i").alias("i"),
        (F.col("t.at") - F.floor("t.at")).alias("frac"),
        F.explode(F.array_distinct(F.array(F.floor("t.at"), F.ceil("t.at")))).alias("pos"),
    ).where((F.col("pos") >= F.col("below")) & (F.col("pos") < F.col("below") + F.col("n")))
    # A few rows per group; written, so that the planner knows their size.
    targets = materialize(targets, "ranks")

    keys = [*groups, "part"]
    held = cut.join(targets.select(*keys).distinct(), keys, "left_semi")
    run = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ladder = held.withColumn("top", F.sum("m").over(run))
    found = targets.join(ladder, keys).where(
        (F.col("pos") - F.col("below") >= F.col("top") - F.col("m"))
        & (F.col("pos") - F.col("below") < F.col("top"))
    )
    ends = found.groupBy(*groups, "i").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("frac").alias("frac")
    )
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac"))
    pairs = F.array_sort(F.collect_list(F.struct("i", value.alias("q"))))
    grouped = ends.groupBy(*groups) if groups else ends
    return grouped.agg(pairs.alias("pairs")).select(
        *groups, F.col("pairs.q").alias("quantiles")
    )
