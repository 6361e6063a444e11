"""Queries on scores of classifiers and clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide.operators import clusters, metrics
from voxtide.operators.classify import class_weights
from voxtide.operators.dbscan import dbscan
from voxtide.plans.registry import query, rounded
from voxtide.sources.tables import table

EPS, MIN_SAMPLES = 1.2, 5

PAIRS = "x AS (SELECT quality AS t, 1 - toxic AS p FROM labels)"
CLASSES = f"""{PAIRS}, names AS (SELECT t AS label FROM x UNION SELECT p FROM x),
c AS (SELECT label, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE p = label) AS claimed,
      count(*) FILTER (WHERE t = label AND p = label) AS hits FROM x, names GROUP BY label),
r AS (SELECT CAST(label AS VARCHAR) AS label, CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS precision,
      CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
      CASE WHEN support + claimed = 0 THEN 0 ELSE CAST(2 AS DOUBLE) * hits / (support + claimed) END AS f1, support, hits FROM c)"""
THREE = ("precision", "recall", "f1")


def _pairs(spark, folder):
    return table(spark, folder, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("p"))


@query("accuracy", "E1", f"WITH {PAIRS} SELECT round(avg(CAST(t = p AS DOUBLE)), 6) AS accuracy FROM x")
def accuracy(spark, folder):
    return rounded(metrics.scores(_pairs(spark, folder), "t", "p").select("accuracy"), "accuracy")


@query("confusion_matrix", "E2", f"""WITH {PAIRS}, n AS (SELECT t AS label FROM x UNION SELECT p FROM x)
SELECT a.label AS true_label, b.label AS predicted_label, count(x.t) AS count FROM n a CROSS JOIN n b
LEFT JOIN x ON x.t = a.label AND x.p = b.label GROUP BY ALL""")
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_pairs(spark, folder), "t", "p")


@query("micro_and_macro_scores", "E3 E5", f"""WITH {CLASSES} SELECT round(sum(hits) / sum(support), 6) AS accuracy,
 {', '.join(f'round(sum(hits) / sum(support), 6) AS {m}_micro' for m in THREE)}, {', '.join(f'round(avg({m}), 6) AS {m}_macro' for m in THREE)},
 {', '.join(f'round(sum({m} * support) / sum(support), 6) AS {m}_weighted' for m in THREE)} FROM r""")
def micro_and_macro_scores(spark, folder):
    out = metrics.scores(_pairs(spark, folder), "t", "p")
    return rounded(out, *out.columns)


@query("classification_report", "E4", f"""WITH {CLASSES}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
UNION ALL SELECT 'macro avg', {', '.join(f'round(avg({m}), 6)' for m in THREE)}, CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', {', '.join(f'round(sum({m} * support) / sum(support), 6)' for m in THREE)}, CAST(sum(support) AS BIGINT) FROM r""")
def classification_report(spark, folder):
    return rounded(metrics.full_report(_pairs(spark, folder), "t", "p"), *THREE)


@query("weighted_f1", "E5", f"WITH {CLASSES} SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM r")
def weighted_f1(spark, folder):
    return rounded(metrics.scores(_pairs(spark, folder), "t", "p").select("f1_weighted"), "f1_weighted")


@query("compare_models", "M11", """
SELECT 'by toxicity' AS model, round(avg(CAST(quality = 1 - toxic AS DOUBLE)), 6) AS accuracy FROM labels
UNION ALL SELECT 'always good', round(avg(CAST(quality = 1 AS DOUBLE)), 6) FROM labels""")
def compare_models(spark, folder):
    rows = _pairs(spark, folder)
    results = [metrics.scores(rows, "t", "p"), metrics.scores(rows.withColumn("p", F.lit(1)), "t", "p"),
               rows.agg(F.count(F.lit(1)).alias("support"))]  # has no accuracy: left out
    out = metrics.compare_models(results, "accuracy", ["by toxicity", "always good", "no metric"])
    return rounded(out, "accuracy")


@query("class_weights", "M5", """
SELECT quality, count(*) AS count, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight
FROM labels GROUP BY quality""")
def balanced_weights(spark, folder):
    return rounded(class_weights(table(spark, folder, "labels"), "quality"), "weight")


DIST = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
SILHOUETTE = f"""n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum({DIST}) AS total FROM embeddings a, embeddings b GROUP BY ALL),
ab AS (SELECT vec_id, d.label, max(CASE WHEN d.label = other THEN size END) AS n,
  max(CASE WHEN d.label = other THEN total / (size - 1) END) AS a, min(CASE WHEN d.label <> other THEN total / size END) AS b
  FROM d JOIN n ON n.label = other GROUP BY ALL),
sil AS (SELECT vec_id, label, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""
POINTS = """e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label, i, avg(x) AS c FROM e GROUP BY ALL),
whole AS (SELECT i, avg(x) AS c FROM e GROUP BY i),
siz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
gap AS (SELECT vec_id, e.label, sum((x - c) * (x - c)) AS sq FROM e JOIN cen ON cen.label = e.label AND cen.i = e.i GROUP BY ALL)"""


@query("silhouette_per_row", "E6", f"WITH {SILHOUETTE} SELECT vec_id, label, round(silhouette, 6) AS silhouette FROM sil")
def silhouette_per_row(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rounded(clusters.silhouette_samples(rows, "vec_id", "label", "embedding", block_rows=200), "silhouette")


@query("clustering_scores", "E6 E7 E8 E9", f"""WITH {SILHOUETTE}, {POINTS},
s AS (SELECT label, avg(sqrt(sq)) AS s FROM gap GROUP BY label),
m AS (SELECT a.label, max((sa.s + sb.s) / dist) AS worst FROM (SELECT a.label, b.label AS other, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS dist
  FROM cen a JOIN cen b ON a.i = b.i AND a.label <> b.label GROUP BY ALL) a JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = a.other GROUP BY a.label),
bet AS (SELECT sum(n * (cen.c - whole.c) * (cen.c - whole.c)) AS b FROM cen JOIN whole ON cen.i = whole.i JOIN siz ON siz.label = cen.label)
SELECT (SELECT count(*) FROM siz) AS n_clusters, (SELECT round(avg(silhouette), 6) FROM sil) AS silhouette,
 (SELECT round(avg(worst), 6) FROM m) AS davies_bouldin,
 (SELECT round(b * ((SELECT sum(n) FROM siz) - (SELECT count(*) FROM siz)) / ((SELECT sum(sq) FROM gap) * ((SELECT count(*) FROM siz) - 1)), 6) FROM bet) AS calinski_harabasz""")
def clustering_scores(spark, folder):
    out = clusters.evaluate_clustering(table(spark, folder, "embeddings"), "vec_id", "label", "embedding")
    return rounded(out, "silhouette", "davies_bouldin", "calinski_harabasz")


@query("silhouette_squared", "E6", """
WITH n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2)) AS total
  FROM embeddings a, embeddings b GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN d.label = other THEN total / (size - 1) END) AS a, min(CASE WHEN d.label <> other THEN total / size END) AS b
  FROM d JOIN n ON n.label = other GROUP BY ALL)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette_sq FROM ab""")
def silhouette_squared(spark, folder):
    value = clusters.silhouette_squared(table(spark, folder, "embeddings"), "label", "embedding")
    return rounded(spark.createDataFrame([(value,)], "silhouette_sq double"), "silhouette_sq")


@query("density_clusters", "C11 C12", f"""
WITH RECURSIVE near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE {DIST} <= {EPS}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id WHERE reach.root < link.b),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
member AS (SELECT id, component FROM comp UNION ALL SELECT a, min(component) FROM near JOIN comp ON comp.id = b
  WHERE a NOT IN (SELECT id FROM core) GROUP BY a),
num AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster FROM (SELECT DISTINCT component FROM comp))
SELECT vec_id, vec_id IN (SELECT id FROM core) AS core, m.component, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster
FROM embeddings LEFT JOIN member m ON m.id = vec_id LEFT JOIN num ON num.component = m.component""")
def density_clusters(spark, folder):
    return dbscan(table(spark, folder, "embeddings"), "vec_id", "embedding", EPS, MIN_SAMPLES, block_rows=256)
