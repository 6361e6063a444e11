"""A third of all rows on one key: the adaptive skew join has to split it."""

import pytest
from pyspark.sql import functions as F

from voxtide.operators import rows, stats, store
from voxtide.operators.components import _lowest, connected_components
from voxtide.session import materialize

N = 300_000
EAGER = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
}


@pytest.fixture
def eager(spark):
    """Sizes at which this small data counts as skewed; no broadcast."""
    before = {k: spark.conf.get(k, None) for k in EAGER}
    for k, v in EAGER.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text():
    return F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))


def split(df):
    """Row count, and whether a skewed partition was split on the way."""
    summary = df.agg(F.count(F.lit(1)), *[F.max(c) for c in df.columns])
    n = summary.collect()[0][0]
    return n, "skew=true" in summary._jdf.queryExecution().executedPlan().toString()


def test_repeated_text(eager):
    feedback = eager.range(0, N, 1, 16).select("id", text().alias("feedback_text"))
    results = eager.range(0, N, 1, 16).select(text().alias("text"), F.lit("Positive").alias("predicted_sentiment"), F.rand(1).alias("confidence"))
    assert split(store.label_rows(results, feedback, "sentiment", "m")) == (N, True)


def test_large_group(eager):
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 5000).cast("string")))
    df = eager.range(0, N, 1, 16).select(group.alias("g"), F.xxhash64("id").alias("v"))
    assert split(stats.box_stats(df, "g", "v"))[1]


def test_hub(eager):
    node = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.xxhash64("id"))
    edges = eager.range(0, N, 1, 16).select(node.alias("u"), F.xxhash64(F.col("id") + 1).alias("v"))
    assert split(edges.join(materialize(_lowest(edges), "lowest"), "u")) == (N, True)


def test_hot_student(eager):
    student = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    base = eager.range(0, N, 1, 16).select(student.alias("student"), F.xxhash64("id").alias("x"))
    keys = eager.range(0, N, 3).select(F.col("id").alias("student"))
    n, was_split = split(rows.delete_rows(base, keys, "student"))
    assert was_split and n == base.where("student % 3 <> 0").count()


def test_large_group_limit(spark):
    df = spark.range(0, N, 1, 16).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("g"))
    out = rows.first_per_group(df, "g", [F.asc("id")], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("g = 0").count() == 3


def test_long_chain_with_hub(spark):
    edges = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - 1).alias("b"))
    out = connected_components(edges, "a", "b")
    assert out.select("component").distinct().count() == 1 and out.count() == 3000
