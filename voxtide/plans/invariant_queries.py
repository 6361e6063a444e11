"""What must hold of fitted models whatever they found, row by row, with the expected rows in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voxtide.operators import classify, clusters, nmf, reduce as reduction, search, stats, topics, ward
from voxtide.operators.features import dense_vector
from voxtide.plans.model_queries import K, TERMS, _clustered, _lda, _nmf, _points, _reduced, _vectors, _vocabulary
from voxtide.plans.registry import query
from voxtide.plans.text_queries import gram_sql
from voxtide.session import materialize
from voxtide.sources.tables import feedback_from_orders, table


@query("topic_shares_sum_to_one", "C3 C15", f"""WITH {gram_sql(TERMS, 1)}
SELECT d.doc_id, {K} AS n_topics, CASE WHEN count(term) > 0 THEN 1.0 ELSE 0.0 END AS total, true AS all_positive
FROM documents d LEFT JOIN tf ON tf.doc_id = d.doc_id GROUP BY d.doc_id""")
def topic_shares_sum_to_one(spark, folder):
    """A text without a known word has no topics: its shares are 0."""
    found = topics.topic_distribution(_lda(spark, folder), _vectors(spark, folder, "count", (1, 1)), "doc_id")
    p = F.col("probabilities")
    return found.select(
        "doc_id", F.size(p).alias("n_topics"), F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        F.forall(p, lambda x: x >= 0).alias("all_positive"),
    )


@query("nmf_weights_are_not_negative", "C2 C14", f"SELECT doc_id, {K} AS n_weights, true AS none_negative FROM documents")
def nmf_weights_are_not_negative(spark, folder):
    found = nmf.nmf_weights(_nmf(spark, folder), _vectors(spark, folder, "count", (1, 1)))
    return found.select("doc_id", F.size("weights").alias("n_weights"), F.forall("weights", lambda x: x >= 0).alias("none_negative"))


@query("kmeans_chooses_the_nearest_centre", "C9 C12 C17", "SELECT vec_id, 0 AS n_nearer FROM embeddings")
def kmeans_chooses_the_nearest_centre(spark, folder):
    points = _points(spark, folder)
    model = clusters.fit_kmeans(points, K)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])  # K rows
    placed = model.transform(points).select("vec_id", vector_to_array("features").alias("v"), "prediction")
    gaps = F.transform(centres, lambda c: clusters.squared_distance(F.col("v"), c))
    placed = placed.withColumn("gaps", gaps)
    nearer = F.filter("gaps", lambda g: g < F.element_at("gaps", F.col("prediction") + 1) - 1e-9)
    return placed.select("vec_id", F.size(nearer).alias("n_nearer"))


@query("hierarchical_clusters_cover_all", "C10 C12", f"SELECT vec_id, 1 AS n_clusters, true AS known FROM embeddings")
def hierarchical_clusters_cover_all(spark, folder):
    found = clusters.cluster(_points(spark, folder), "vec_id", "hierarchical", K)
    return found.groupBy("vec_id").agg(
        F.count("*").cast("int").alias("n_clusters"), F.bool_and(F.col("cluster").between(0, K - 1)).alias("known")
    )


@query("ward_heights_hold_the_variance", "C10", """
WITH x AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
s AS (SELECT i, sum(v * v) - sum(v) * sum(v) / count(*) AS part, count(*) AS n FROM x GROUP BY i)
SELECT max(n)::BIGINT AS n_rows, round(sum(part), 3) AS variance FROM s""")
def ward_heights_hold_the_variance(spark, folder):
    """Each merge adds half its squared height to the variance inside clusters; after the last one that is all there is."""
    points = table(spark, folder, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    n, total = ward.fit_ward(points, "v").variance()
    return spark.createDataFrame([(n, round(total, 3))], "n_rows bigint, variance double")


def _axes(df, vector: str, k: int):
    """(i, j, cosine) of the columns of the reduced rows, i < j."""
    x = F.col(vector)
    products = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (x[i] * x[j]).alias("p")) for i in range(k) for j in range(i, k)])
    sums = df.select(F.inline(products)).groupBy("i", "j").agg(F.sum("p").alias("p"))  # k * k rows
    length = sums.where("i = j").select(F.col("i").alias("axis"), F.sqrt("p").alias("length"))
    a, b = length.withColumnsRenamed({"axis": "i", "length": "a"}), length.withColumnsRenamed({"axis": "j", "length": "b"})
    return sums.where("i < j").join(a, "i").join(b, "j").select("i", "j", F.try_divide("p", F.col("a") * F.col("b")).alias("cosine"))


PAIRS = "SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, true AS orthogonal FROM range({0}) a(i), range({0}) b(i) WHERE a.i < b.i"


@query("svd_axes_are_orthogonal", "C13", PAIRS.format(8))
def svd_axes_are_orthogonal(spark, folder):
    return _axes(_reduced(spark, folder), "reduced", 8).select("i", "j", (F.abs("cosine") < 0.05).alias("orthogonal"))


@query("pca_axes_are_orthogonal", "C16", PAIRS.format(3))
def pca_axes_are_orthogonal(spark, folder):
    reduced = reduction.pca(_points(spark, folder), keep=["vec_id"], k=3)
    return _axes(reduced, "reduced", 3).select("i", "j", (F.abs("cosine") < 1e-6).alias("orthogonal"))


@query("text_clusters_cover_all", "C9 C13 C18", "SELECT doc_id, 1 AS n_clusters FROM documents")
def text_clusters_cover_all(spark, folder):
    return _clustered(spark, folder).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_clusters"))


@query("approximate_count_is_close", "A6", "SELECT count(DISTINCT o_custkey) AS exact, true AS within_three_deviations FROM orders")
def approximate_count_is_close(spark, folder):
    """The approximate count, with a standard deviation of 1 %, is at most 3 % off."""
    fb = feedback_from_orders(spark, folder)
    # Together, each distinct student would carry a sketch of its own through the shuffle.
    exact, near = fb.agg(F.count_distinct("student").alias("exact")), fb.agg(F.approx_count_distinct("student", 0.01).alias("near"))
    both = exact.crossJoin(F.broadcast(near))  # one row each
    return both.select("exact", (F.abs(F.col("near") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within_three_deviations"))


@query("distinct_per_quarter_from_sketches", "A6", """
SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, count(DISTINCT o_custkey) AS exact, true AS within_three_errors
FROM orders GROUP BY 1""")
def distinct_per_quarter_from_sketches(spark, folder):
    """Daily sketches, stored and read back, give the distinct customers of each quarter within three standard errors."""
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    daily = materialize(stats.distinct_sketches(orders, "o_custkey", ["day"]), "sketches")
    quarter = F.date_trunc("quarter", "day").cast("date").alias("quarter")
    near = stats.distinct_from_sketches(daily.select(quarter, "sketch"), ["quarter"])
    exact = orders.groupBy(quarter).agg(F.count_distinct("o_custkey").alias("exact"))
    gap = F.abs(F.col("distinct_values") - F.col("exact"))
    return exact.join(near, "quarter").select("quarter", "exact", (gap <= 3 * stats.SKETCH_ERROR * F.col("exact") + 1).alias("within_three_errors"))


@query("forest_is_its_trees", "M3 L6", "SELECT vec_id, true AS votes_add_up, true AS shares_add_up FROM embeddings WHERE label IS NOT NULL")
def forest_is_its_trees(spark, folder):
    """The votes of a forest are the summed class shares of its trees, walked here node by node; importances add up to 1."""
    points = table(spark, folder, "embeddings").where("label is not null").select(
        "vec_id", F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("v"), dense_vector("embedding").alias("features"))
    model = RandomForestClassifier(numTrees=10, maxDepth=8, seed=42, featureSubsetStrategy="sqrt").fit(points.select("features", "label"))
    model = classify.without_summary(spark, model)
    found = search.Forest.of(spark, model)
    sent = spark.sparkContext.broadcast((found.feature, found.threshold, found.left, found.right, found.shares, found.roots))

    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forest = search.Forest(*sent.value)
        for v in batches:
            yield pd.Series(list(forest.votes(np.vstack(v.to_numpy()), [10], [8])[0, 0])) if len(v) else pd.Series([], dtype=object)

    scored = model.transform(points).withColumn("walked", F.pandas_udf(votes, "array<double>")("v"))
    gaps = F.zip_with(vector_to_array("rawPrediction"), F.col("walked"), lambda a, b: F.abs(a - b))
    total = float(sum(model.featureImportances.toArray()))
    return scored.select("vec_id", (F.array_max(gaps) < 1e-6).alias("votes_add_up"), F.lit(abs(total - 1) < 1e-9).alias("shares_add_up"))


@query("topics_are_distributions", "C1 E10", f"SELECT t::INTEGER AS topic, true AS within_vocabulary, true AS adds_up, true AS positive FROM range({K}) r(t)")
def topics_are_distributions(spark, folder):
    """Each topic's term weights, made to shares, are positive and add up to 1, and none is missing."""
    weights = topics.topic_terms(spark, _lda(spark, folder), _vocabulary(spark, folder, "count", (1, 1)))
    total = weights.groupBy("topic").agg(F.sum("weight").alias("total"))
    shares = weights.join(F.broadcast(total), "topic").withColumn("share", F.col("weight") / F.col("total"))  # one row per topic
    return shares.groupBy(F.col("topic").cast("int").alias("topic")).agg(
        (F.count(F.lit(1)) <= TERMS).alias("within_vocabulary"), (F.abs(F.sum("share") - 1) < 1e-9).alias("adds_up"), F.min(F.col("share") > 0).alias("positive"))
