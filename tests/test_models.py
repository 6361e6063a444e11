"""Fitted models: shapes, invariants, brute-force comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.functions.text import word_tokens
from voxtide.operators import classify, clusters, features, nmf, reduce as reduction, topics
from voxtide.operators.components import connected_components
from voxtide.operators.dbscan import dbscan

TEXTS = [
    "The mathematics course was excellent and I learned a lot",
    "The teaching quality was poor and the lectures were confusing",
    "The library resources were adequate for the course",
    "Great professor and engaging lectures in physics",
    "The laboratory facilities need significant improvement",
] * 5


def random_rows(spark, n=100, width=50, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.random(width)], ["Positive", "Neutral", "Negative"][i % 3]) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, sentiment string")
    return df.select("id", "sentiment", features.dense_vector("v").alias("features")).coalesce(1)


@pytest.mark.parametrize("model,point", [
    ("logistic_regression", {"C": 0.05}), ("naive_bayes", {}), ("random_forest", {"n_estimators": 5, "max_depth": 5}),
    ("svm", {"C": 0.01}),
])
def test_classifiers(spark, model, point):
    df = random_rows(spark)
    fitted = classify.train(df, "sentiment", model, **point)
    out = classify.predict(fitted, random_rows(spark, 10, seed=1).drop("sentiment"), "sentiment").collect()
    assert len(out) == 10 and {r["predicted_sentiment"] for r in out} <= {"Positive", "Neutral", "Negative"}
    score, report = classify.evaluate(fitted, df, "sentiment")
    assert 0 <= score.first()["accuracy"] <= 1 and report.count() == 5


@pytest.mark.parametrize("model", ["logistic_regression", "svm"])
def test_two_classes_after_an_import(spark, tmp_path, model):
    """An import leaves nothing in the session that keeps two-class models from being sent out."""
    from voxtide.operators.store import Store

    feedback = Store(spark, str(tmp_path))
    feedback.create_tables()
    assert feedback.import_feedback(spark.createDataFrame([("a",), ("b",)], "feedback_text string"), ["feedback_text"], "2024-01-01") == 2
    assert feedback.import_feedback(spark.createDataFrame([("c",)], "feedback_text string"), ["feedback_text"], "2024-01-01") == 1
    df = random_rows(spark).where("sentiment <> 'Neutral'")
    out = classify.predict(classify.train(df, "sentiment", model, C=0.05), df, "sentiment")
    assert out.select("predicted_sentiment").distinct().count() == 2


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        classify.train(random_rows(spark, 9, 3), "sentiment", "perceptron")
    with pytest.raises(ValueError):
        classify.tune(random_rows(spark, 9, 3), "sentiment", "id", "perceptron")


def test_tuning(spark):
    best, score, model = classify.tune(random_rows(spark, 60, 8), "sentiment", "id", "naive_bayes", {"alpha": [0.5, 1.0]}, folds=3)
    assert best["alpha"] in (0.5, 1.0) and 0 <= score <= 1
    assert "predicted_sentiment" in model.transform(random_rows(spark, 5, 8)).columns


def test_folds_are_even(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 90, "hot").otherwise("rare").alias("label"))
    sizes = classify.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in ("hot", "rare"):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "c string")
    assert {r["c"]: round(r["weight"], 6) for r in classify.class_weights(df, "c").collect()} == {"a": 0.666667, "b": 2.0}


def text_vectors(spark, method="count", ngram_range=(1, 1), n=100):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    vocabulary = features.fit_vocabulary(docs, "text", method, n, ngram_range)
    return docs, vocabulary, features.vectorize(docs, "doc_id", "text", vocabulary).cache()


def test_lda(spark):
    docs, vocabulary, vectors = text_vectors(spark)
    model = topics.fit_lda(vectors, 3)
    words = topics.topic_words(topics.topic_terms(spark, model, vocabulary), 5).collect()
    assert len(words) == 3 and all(len(r["words"]) == 5 for r in words)
    shares = topics.topic_distribution(model, vectors, "doc_id")
    wide = topics.wide_distribution(shares, "doc_id", 3).collect()
    assert len(wide) == len(TEXTS)
    for r in wide:
        values = [r[f"Topic_{i}"] for i in (1, 2, 3)]
        assert sum(values) == pytest.approx(1) and r["Dominant_Topic"] == f"Topic_{values.index(max(values)) + 1}"
    best, chosen, table = topics.find_topic_count(vectors, docs, word_tokens(F.col("text")), vocabulary, 2, 4, passes=2, top=5)
    assert table.count() == 2 and best in (2, 3) and chosen.getK() == best


def test_perplexity_of_new_texts(spark):
    """Equal to a plain loop, and lower than with the shares of other texts."""
    rng = np.random.default_rng(4)
    topic_of = lambda n: [" ".join(f"w{t}x{rng.integers(12)}" for _ in range(40)) for t in range(3) for _ in range(n)]
    known = spark.createDataFrame(list(enumerate(topic_of(30))), "doc_id long, text string")
    new = [*topic_of(5), "unheard words only", "w0x1", None, "", "nothing w1x1 known w1x2"]
    docs = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    vocabulary = features.fit_vocabulary(known, "text", "count", 100, (1, 1))
    model = topics.fit_lda(features.vectorize(known, "doc_id", "text", vocabulary), 3, passes=20)
    done = topics.complete_texts(model, docs, "doc_id", "text", vocabulary)
    got = {r["doc_id"]: (r["n_words"], r["log_likelihood"]) for r in done.collect()}

    told = spark.createDataFrame([(i, " ".join((t or "").split()[::2])) for i, t in enumerate(new)], "doc_id long, text string")
    found = topics.topic_distribution(model, features.vectorize(told, "doc_id", "text", vocabulary), "doc_id").collect()
    shares = {r["doc_id"]: np.array(r["probabilities"]) if sum(r["probabilities"]) else np.full(3, 1 / 3) for r in found}
    chances = model.topicsMatrix().toArray() / model.topicsMatrix().toArray().sum(axis=0)
    place = {t: i for i, t in enumerate(vocabulary.terms)}

    def loop(i, by):
        rest = [w for w in (new[i] or "").split()[1::2] if w in place]
        return len(rest), sum(np.log(chances[place[w]] @ shares[by]) for w in rest)

    want = {i: loop(i, i) for i in range(len(new)) if loop(i, i)[0]}
    assert set(got) == set(want) == {*range(15), 19}  # the last is scored with the prior's shares
    assert all(got[i][0] == n and got[i][1] == pytest.approx(v) for i, (n, v) in want.items())
    total = topics.perplexity(done).first()
    n, value = sum(n for n, _ in want.values()), sum(v for _, v in want.values())
    assert (total["n_texts"], total["n_words"], total["perplexity"]) == (16, n, pytest.approx(np.exp(-value / n)))
    assert value > sum(loop(i, (i + 5) % 15)[1] for i in range(15)) + 50
    none = topics.perplexity(done.where("doc_id < 0")).first()
    assert tuple(none) == (0, 0, None)


def test_nmf(spark):
    _, vocabulary, vectors = text_vectors(spark)
    width = len(vocabulary.terms)
    model = nmf.fit_nmf(vectors, width, k=3, rounds=12)
    assert (model.components >= 0).all() and model.components.shape == (3, width)
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    weights = np.array([r["weights"] for r in nmf.nmf_weights(model, vectors).orderBy("doc_id").collect()])
    assert weights.shape == (len(TEXTS), 3) and (weights >= 0).all()
    x = np.array([r["features"].toArray() for r in vectors.orderBy("doc_id").collect()])
    h = model.components
    loss = 0.5 * ((x - weights @ h) ** 2).sum() + model.l1 * (weights.sum() + h.sum())
    loss += 0.5 * model.l2 * ((weights**2).sum() + (h**2).sum())
    assert loss <= model.losses[-1] + 1e-6
    assert topics.top_terms_per_topic(topics.topic_terms(spark, model, vocabulary), 5).count() == 15


def test_svd(spark):
    _, vocabulary, vectors = text_vectors(spark, "tfidf", (1, 2))
    x = np.array([r["features"].toArray() for r in vectors.orderBy("doc_id").collect()])
    values, basis = reduction.svd_basis(vectors, len(vocabulary.terms), k=4)
    assert values == pytest.approx(np.linalg.svd(x, compute_uv=False)[:4], abs=1e-6)
    assert basis.T @ basis == pytest.approx(np.eye(4), abs=1e-8)
    reduced = reduction.truncated_svd(vectors, len(vocabulary.terms), k=4).orderBy("doc_id").collect()
    assert np.linalg.norm([r["reduced"] for r in reduced], axis=0) == pytest.approx(values, abs=1e-6)


def test_pca(spark):
    df = random_rows(spark, 60, 6)
    out = np.array([r["reduced"] for r in reduction.pca(df, keep=["id"]).orderBy("id").collect()])
    x = np.array([r["features"].toArray() for r in df.orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    want = centred @ np.linalg.svd(centred)[2][:2].T
    assert np.abs(out) == pytest.approx(np.abs(want), abs=1e-8)


def test_window_counts_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [list(rng.choice(list("abcdefgh"), n)) for n in (0, 3, 9, 10, 11, 40, 200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t array<string>")
    words, window = ["a", "b", "c"], 10
    want, total = {}, 0
    for t in texts:
        spans = [t[s : s + window] for s in range(max(len(t) - window + 1, 1))] if t else []
        total += len(spans)
        for span in spans:
            for i, a in enumerate(words):
                for b in words[i:]:
                    want[a, b] = want.get((a, b), 0) + (a in span and b in span)
    want[None, None] = total
    got = {(r[0], r[1]): r[2] for r in topics.window_counts(df, F.col("t"), words, window).collect()}
    assert got == want
    previous, topics.STARTS = topics.STARTS, 7
    try:
        assert {(r[0], r[1]): r[2] for r in topics.window_counts(df, F.col("t"), words, window).collect()} == want
    finally:
        topics.STARTS = previous


def points(spark, x, labels=None):
    rows = [(i, [float(c) for c in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, label int")


def test_kmeans_and_hierarchical(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    df = points(spark, x).select("id", features.dense_vector("v").alias("features"))
    for method in ("kmeans", "hierarchical"):
        found = [r["cluster"] for r in clusters.cluster(df, "id", method, 3).orderBy("id").collect()]
        assert len({tuple(found[i : i + 20]) for i in (0, 20, 40)}) == 3 and len(set(found)) == 3
    best = clusters.fit_kmeans(df, 2, restarts=3).summary.trainingCost
    assert all(best <= clusters.fit_kmeans(df, 2, restarts=1, seed=42 + i).summary.trainingCost + 1e-9 for i in range(3))
    with pytest.raises(ValueError):
        clusters.cluster(df, "id", "spectral")


def brute_silhouette(x, labels):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i in range(len(x)):
        same = (labels == labels[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_cluster_scores(spark):
    rng = np.random.default_rng(2)
    x, labels = rng.normal(size=(70, 3)), np.array([-1] * 5 + [0] * 34 + [1] * 30 + [2])
    df = points(spark, x, labels)
    kept = labels != -1
    out = clusters.silhouette_samples(df.where("label <> -1"), "id", "label", "v", block_rows=16).orderBy("id").collect()
    assert [r["silhouette"] for r in out] == pytest.approx(brute_silhouette(x[kept], labels[kept]))
    row = clusters.evaluate_clustering(df, "id", "label", "v").first()
    assert row["silhouette"] == pytest.approx(brute_silhouette(x[kept], labels[kept]).mean())
    names = sorted(set(labels))
    centres = {c: x[labels == c].mean(axis=0) for c in names}
    spread = {c: np.linalg.norm(x[labels == c] - centres[c], axis=1).mean() for c in names}
    worst = [max((spread[a] + spread[b]) / np.linalg.norm(centres[a] - centres[b]) for b in names if b != a) for a in names]
    assert row["davies_bouldin"] == pytest.approx(np.mean(worst))
    between = sum((labels == c).sum() * ((centres[c] - x.mean(axis=0)) ** 2).sum() for c in names)
    within = sum(((x[labels == c] - centres[c]) ** 2).sum() for c in names)
    assert row["calinski_harabasz"] == pytest.approx(between * (70 - 4) / (within * 3))
    single = clusters.evaluate_clustering(df.withColumn("label", F.lit(1)), "id", "label", "v").first()
    assert single["n_clusters"] == 1 and single["silhouette"] is None and single["davies_bouldin"] is None


def brute_dbscan(x, eps, least):
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(axis=1) >= least
    labels, number = np.full(len(x), -1), 0
    for start in range(len(x)):
        if not core[start] or labels[start] != -1:
            continue
        stack = [start]
        while stack:
            p = stack.pop()
            for q in np.flatnonzero(near[p] & (labels == -1)):
                labels[q] = number
                if core[q]:
                    stack.append(q)
        number += 1
    return core, labels


@pytest.mark.parametrize("block_rows", [16, 500])
def test_dbscan_by_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    clump = rng.normal(0, 0.05, (60, 2))  # a third of all points in one place
    moons = np.array([[np.cos(t), np.sin(t)] for t in np.linspace(0, np.pi, 50)]) * 3 + rng.normal(0, 0.05, (50, 2)) + 4
    x = np.vstack([clump, moons, rng.uniform(-4, 9, (70, 2))])
    x = x[rng.permutation(len(x))]
    core, labels = brute_dbscan(x, 0.5, 5)
    out = dbscan(points(spark, x), "id", "v", 0.5, 5, block_rows=block_rows).orderBy("id").collect()
    assert [r["core"] for r in out] == core.tolist()
    assert [r["cluster"] for r in out] == labels.tolist()
    assert len(set(labels)) > 2


def test_dbscan_all_noise(spark):
    out = dbscan(points(spark, np.arange(12).reshape(6, 2) * 10.0), "id", "v", 0.5, 2).collect()
    assert {r["cluster"] for r in out} == {-1} and len(out) == 6


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (7, 7)]
    edges = spark.createDataFrame(chain, "a bigint, b bigint")
    out = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(30))
    assert out[200] == out[201] == 200 and len(out) == 41 + 30 + 2


def test_dbscan_copies_points_once_per_region(spark):
    """Blocks that all meet must not copy a point once per block."""
    from voxtide.operators import dbscan as density

    x = np.random.default_rng(4).normal(size=(600, 8))
    points_ = points(spark, x).select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    cut, regions, _ = density._blocks(points_, 100.0, 4, 1024)
    assert regions == density.REGIONS and cut.select("block").distinct().count() > 100
    assert density._meet(cut, regions).count() == 600 * regions


def test_silhouette_copies_stay_few():
    """Rows of tasks grow before copies do: cuts stay few until a block would hold more than LARGEST rows."""
    assert clusters._cuts(600_000, 200, clusters.ASKERS) == clusters.ASKERS
    assert clusters._cuts(10 * clusters.LARGEST, 200, 2) == 10 and clusters._cuts(150, 200, 2) == 1 and clusters._cuts(0, 200, 2) == 1


def test_runs_of_kmeans_share_their_passes(spark):
    """As many jobs as the longest run has steps, and each run ends where it does in a plain loop."""
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 1.0, (60, 3)) for c in (0, 2, 4)])
    starts = [x[rng.choice(len(x), 3, replace=False)] for _ in range(4)]
    df = points(spark, x).select("v").repartition(3)
    group = "moves of centres"
    spark.sparkContext.setJobGroup(group, group)
    found = clusters._move(df, starts)
    spark.sparkContext.setJobGroup("", "")
    for (centres, summary), start in zip(found, starts, strict=True):
        own, steps = start.copy(), 0
        while True:
            near = ((x[:, None] - own) ** 2).sum(axis=2)
            new = np.array([x[near.argmin(axis=1) == j].mean(axis=0) for j in range(3)])
            steps, gap, own = steps + 1, ((new - own) ** 2).sum(axis=1).max(), new
            if gap <= 1e-8:
                break
        assert centres == pytest.approx(own) and summary.numIter == steps
        assert summary.trainingCost == pytest.approx(near.min(axis=1).sum())
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert len(jobs) <= max(s.numIter for _, s in found) + 3


@pytest.mark.parametrize("n", [2, 40])
def test_sparse_products(spark, n):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((70, 11)) < 0.2, rng.normal(size=(70, 11)), 0.0)
    x[:5] = 0.0
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist(), i) for i, r in enumerate(x)], "indices array<int>, values array<double>, y int")
    w, s = rng.normal(size=(11, n)), rng.normal(size=(70, n))

    def work(out, block, y):
        out[:, :11] += block.summed(s[y])
        out[:, 11:22] += block.summed(s[y], square=True)
        out[:, 22:] += block.times(w).T @ s[y]

    found = reduction.sum_of_packed(reduction.packed(rows.repartition(3), ["y"], rows=16), 11, work, (n, 22 + n))
    assert found == pytest.approx(np.hstack([s.T @ x, s.T @ x**2, (x @ w).T @ s]))


def test_forests_keep_the_nodes_of_rows(spark, monkeypatch):
    """Rows remember their node in every tree between levels; the trees are those of walking down again."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.linalg import Vectors

    from voxtide.operators import search

    rng = np.random.default_rng(9)
    data = [(i, "ab"[int(x[0] + x[3] > 1)], Vectors.dense(x)) for i, x in enumerate(rng.uniform(size=(120, 6)).round(1))]
    df = spark.createDataFrame(data, ["id", "kind", "features"]).cache()
    indexed = StringIndexer(inputCol="kind", outputCol="label").fit(df).transform(df).withColumn("weight", F.lit(1.0))
    estimator = classify.make_estimator("random_forest", 120, 2, n_estimators=5)
    assert estimator.getCacheNodeIds()
    with_, without = (e.fit(indexed).toDebugString.split("\n", 1)[1] for e in (estimator, estimator.copy().setCacheNodeIds(False)))
    assert with_ == without
    made, plain = [], search.RandomForestClassifier
    monkeypatch.setattr(search, "RandomForestClassifier", lambda **point: made.append(point) or plain(**point))
    rows = search.fold_rows(df, "kind", "id", ["a", "b"], 2)  # written once: forests depend on how rows lie
    settings = [("random_forest", p) for p in search.grid_points({"n_estimators": [2, 3], "max_depth": [2, None]})]
    found = search.forest_trials(rows, 6, 2, 2, settings)
    assert [p["cacheNodeIds"] for p in made] == [True, True]
    monkeypatch.setattr(search, "RandomForestClassifier", lambda **point: plain(**{**point, "cacheNodeIds": False}))
    assert search.forest_trials(rows, 6, 2, 2, settings) == found
