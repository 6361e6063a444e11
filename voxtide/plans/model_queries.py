"""Queries that fit models: classifiers, topics, clusters, reductions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions import text as tx
from voxtide.operators import classify, clusters, features, nmf, reduce as reduction, rows, search, stats, store, topics, ward
from voxtide.plans.registry import query, rounded
from voxtide.plans.rows_queries import _h
from voxtide.plans.text_queries import gram_sql
from voxtide.sources.tables import fingerprint, labelled_documents, table

TERMS = 5000
K = 5
_FITTED: dict = {}  # of one set of files


def fitted(spark, folder, name, make):
    """Fit once per session and set of files; the queries below share vocabularies and models.

    Files are told apart by name, size and time of change. When others are asked for, what was
    fitted on the last ones is released.
    """
    files = (spark.sparkContext.applicationId, fingerprint(spark, folder, ["documents", "labels", "conversations", "embeddings"]))
    if _FITTED.get("files") != files:
        for old in _FITTED.values():
            if isinstance(old, DataFrame):
                old.unpersist()
        _FITTED.clear()
        _FITTED["files"] = files
    if name not in _FITTED:
        _FITTED[name] = make()
    return _FITTED[name]


def _docs(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    sentiment = F.when(F.col("quality") == 1, "Positive").when(F.col("quality") == 0, "Negative")
    return docs.select("doc_id", "text", F.col("lang").alias("category"), sentiment.alias("sentiment"))


def _vocabulary(spark, folder, method="tfidf", ngram_range=(1, 2)):
    """TF-IDF has the terms of the counts; their documents are told from the counted vectors."""

    def make():
        if method != "tfidf":
            return features.fit_vocabulary(_docs(spark, folder), "text", method, TERMS, ngram_range)
        terms = _vocabulary(spark, folder, "count", ngram_range).terms
        idf = features.inverse_frequency_of_counted(_vectors(spark, folder, "count", ngram_range), "features", len(terms))
        return features.Vocabulary(terms, ngram_range, method, idf)

    return fitted(spark, folder, (method, ngram_range), make)


def _vectors(spark, folder, method="tfidf", ngram_range=(1, 2)) -> DataFrame:
    """Feature rows, kept in memory and on disk: several fits and scorings read them."""

    def make():
        vocabulary = _vocabulary(spark, folder, method, ngram_range)
        if method == "tfidf":
            return features.weigh(_vectors(spark, folder, "count", ngram_range), "features", vocabulary, "features").cache()
        return features.vectorize(_docs(spark, folder), "doc_id", "text", vocabulary, ["category", "sentiment"]).cache()

    return fitted(spark, folder, ("vectors", method, ngram_range), make)


def _report(spark, folder, label: str, model: str, method: str = "tfidf", **point) -> DataFrame:
    train, test = rows.split_rows(_vectors(spark, folder, method), "doc_id")
    found = classify.train(train, label, model, **point)
    return classify.evaluate(found, test, label)[0]


@query("logistic_regression_scores", "M1 M6 M7")
def logistic_regression_scores(spark, folder):
    return _report(spark, folder, "sentiment", "logistic_regression")


@query("multinomial_logistic_regression_scores", "M1 M7")
def multinomial_logistic_regression_scores(spark, folder):
    return _report(spark, folder, "category", "logistic_regression")


@query("random_forest_scores", "M3 M7")
def random_forest_scores(spark, folder):
    return _report(spark, folder, "category", "random_forest")


@query("svm_scores", "M4 M7")
def svm_scores(spark, folder):
    return _report(spark, folder, "category", "svm")


NB = f"""{gram_sql(TERMS)}, v AS (SELECT count(*) AS size FROM vocab),
ct AS (SELECT lang AS category, term, sum(n) AS n FROM tf JOIN documents USING (doc_id) GROUP BY ALL),
tot AS (SELECT category, sum(n) AS n FROM ct GROUP BY category),
ll AS (SELECT tot.category, vocab.term, ln((1 + coalesce(ct.n, 0)) / (tot.n + v.size)) AS log_likelihood
  FROM tot CROSS JOIN vocab CROSS JOIN v LEFT JOIN ct ON ct.category = tot.category AND ct.term = vocab.term)"""


def _bayes(spark, folder):
    rows_ = _vectors(spark, folder, "count")
    return fitted(spark, folder, "naive bayes", lambda: classify.train(rows_, "category", "naive_bayes"))


@query("naive_bayes_likelihoods", "M2", f"WITH {NB} SELECT category, term, round(log_likelihood, 6) AS log_likelihood FROM ll")
def naive_bayes_likelihoods(spark, folder):
    docs = _docs(spark, folder)
    labels = stats.label_values(docs, "category")
    vocabulary = _vocabulary(spark, folder, "count")
    out = classify.naive_bayes_likelihoods(docs, "category", _bayes(spark, folder), vocabulary, labels)
    return rounded(out, "log_likelihood")


@query("naive_bayes_predictions", "M2 M6", f"""WITH {NB},
pri AS (SELECT lang AS category, ln(count(*) / (SELECT count(*) FROM documents)) AS p FROM documents GROUP BY lang),
sc AS (SELECT d.doc_id, pri.category, p + coalesce(sum(n * log_likelihood), 0) AS s FROM documents d CROSS JOIN pri
  LEFT JOIN tf ON tf.doc_id = d.doc_id LEFT JOIN ll ON ll.category = pri.category AND ll.term = tf.term GROUP BY d.doc_id, pri.category, p)
SELECT doc_id, arg_max(category, s) AS predicted_category FROM sc GROUP BY doc_id""")
def naive_bayes_predictions(spark, folder):
    scored = classify.predict(_bayes(spark, folder), _vectors(spark, folder, "count"), "category")
    return scored.select("doc_id", "predicted_category")


@query("stratified_folds", "M8", f"""
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id', '', 'slice42')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""")
def stratified_folds(spark, folder):
    return classify.stratified_folds(table(spark, folder, "labels").select("doc_id", "quality"), "quality", "doc_id")


def _trials(spark, folder):
    """All settings of all kinds of model: naive Bayes and forests on counts, linear models on TF-IDF."""

    def make():
        linear_ = search.search(_vectors(spark, folder), "category", "doc_id", ("logistic_regression", "svm"))
        return linear_ + search.search(_vectors(spark, folder, "count"), "category", "doc_id", ("naive_bayes", "random_forest"))

    return fitted(spark, folder, "trials", make)


def _trial_rows(spark, trials):
    rows_ = [(t.model, ", ".join(f"{k}={v}" for k, v in t.point.items()), t.f1) for t in trials]
    return spark.createDataFrame(rows_, "model string, parameters string, f1 double")


@query("model_search", "M8 M9")
def model_search(spark, folder):
    return _trial_rows(spark, _trials(spark, folder))


@query("tuned_model", "M8 M9")
def tuned_model(spark, folder):
    """The best setting of each of the four kinds of model."""
    return _trial_rows(spark, search.best_trials(_trials(spark, folder)))


@query("naive_bayes_search", "M8 M9", f"""WITH {gram_sql(TERMS)}, v AS (SELECT count(*) AS size FROM vocab),
fo AS (SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY {_h('doc_id', '', 'slice42')}, doc_id) - 1) % 5 AS INTEGER) AS fold
  FROM documents WHERE lang IS NOT NULL),
ct AS (SELECT fold, lang, term, sum(n) AS n FROM tf JOIN fo USING (doc_id) GROUP BY ALL),
tr AS MATERIALIZED (SELECT f.fold, lang, term, sum(n) AS n FROM ct JOIN range(5) f(fold) ON ct.fold <> f.fold GROUP BY ALL),
tot AS (SELECT fold, lang, sum(n) AS n FROM tr GROUP BY ALL),
pri AS (SELECT f.fold, lang, ln(count(*) / sum(count(*)) OVER (PARTITION BY f.fold)) AS p FROM fo JOIN range(5) f(fold) ON fo.fold <> f.fold GROUP BY f.fold, lang),
al AS (SELECT unnest([0.1, 0.5, 1.0, 2.0]) AS alpha),
sc AS (SELECT fo.doc_id, fo.fold, fo.lang AS truth, alpha, pri.lang AS guess,
    p + coalesce(sum(tf.n * (ln(coalesce(tr.n, 0) + alpha) - ln(tot.n + alpha * v.size))), 0) AS s
  FROM fo JOIN pri USING (fold) JOIN tot ON tot.fold = pri.fold AND tot.lang = pri.lang CROSS JOIN al CROSS JOIN v
  LEFT JOIN tf ON tf.doc_id = fo.doc_id LEFT JOIN tr ON tr.fold = fo.fold AND tr.lang = pri.lang AND tr.term = tf.term
  GROUP BY fo.doc_id, fo.fold, fo.lang, alpha, pri.lang, p),
ch AS (SELECT doc_id, fold, truth, alpha, arg_max(guess, s) AS guess FROM sc GROUP BY ALL),
pc AS (SELECT alpha, fold, lang, count_if(truth = lang) AS support, count_if(guess = lang) AS chosen, count_if(truth = lang AND guess = lang) AS hit
  FROM ch JOIN (SELECT DISTINCT lang FROM fo) l ON truth = lang OR guess = lang GROUP BY alpha, fold, lang),
pf AS (SELECT alpha, fold, sum(support * 2.0 * hit / (support + chosen)) / sum(support) AS f1 FROM pc GROUP BY alpha, fold)
SELECT alpha::DOUBLE AS alpha, round(avg(f1), 6) AS f1 FROM pf GROUP BY alpha""")
def naive_bayes_search(spark, folder):
    trials = search.search(_vectors(spark, folder, "count"), "category", "doc_id", ("naive_bayes",))
    return rounded(spark.createDataFrame([(float(t.point["alpha"]), t.f1) for t in trials], "alpha double, f1 double"), "f1")


@query("svm_is_optimal", "M4", "SELECT DISTINCT lang AS category, true AS optimal FROM documents WHERE lang IS NOT NULL")
def svm_is_optimal(spark, folder):
    """Where the squared hinge has its minimum, each weight is the summed pull of the rows inside the margin.

    The gradient is computed again from the long form of the vectors and compared with the one at 0.
    """
    vectors = _vectors(spark, folder).where("category is not null").select("doc_id", "category", "features")
    model = fitted(spark, folder, "svm", lambda: classify.train(vectors, "category", "svm"))
    weights = model.table(vectors).withColumnRenamed("class", "side")
    bias = F.broadcast(weights.where("index < 0").select("side", F.col("weight").alias("bias")))  # one row per class
    entries = classify.with_weights(vectors, "category").transform(lambda df: features.entries("features", "doc_id", df)).cache()
    rows_ = classify.with_weights(vectors, "category").select("doc_id", "category", F.col("weight").alias("row_weight"))
    products = entries.join(F.broadcast(weights), "index").groupBy("doc_id", "side").agg(F.sum(F.col("value") * F.col("weight")).alias("product"))
    sign = F.when(F.col("category") == F.col("side"), 1.0).otherwise(-1.0)
    scored = rows_.join(bias, F.lit(True)).join(products, ["doc_id", "side"], "left").withColumn("sign", sign)
    margin = F.col("sign") * (F.coalesce("product", F.lit(0.0)) + F.col("bias"))
    pull = scored.select("doc_id", "side", (2 * F.col("sign") * F.col("row_weight") * F.greatest(F.lit(0.0), 1 - margin)).alias("pull"),
                         (2 * F.col("sign") * F.col("row_weight")).alias("first"))
    sums = entries.join(pull, "doc_id").groupBy("side", "index").agg(F.sum(F.col("value") * F.col("pull")).alias("pull"), F.sum(F.col("value") * F.col("first")).alias("first"))
    sums = sums.join(weights, ["side", "index"], "left").select("side", (F.coalesce("weight", F.lit(0.0)) - F.col("pull")).alias("slope"), "first")
    tilt = pull.groupBy("side").agg(F.sum("pull").alias("slope"), F.sum("first").alias("first")).select("side", "slope", "first")
    both = sums.unionByName(tilt).groupBy("side").agg(F.sqrt(F.sum(F.col("slope") ** 2)).alias("slope"), F.sqrt(F.sum(F.col("first") ** 2)).alias("first"))
    return both.select(F.col("side").alias("category"), (F.col("slope") <= 0.02 * F.col("first")).alias("optimal"))


@query("score_new_feedback", "M10", f"""WITH {NB},
pri AS (SELECT lang AS category, ln(count(*) / (SELECT count(*) FROM documents)) AS p FROM documents GROUP BY lang),
said AS (SELECT conv_id * 100000 + turn AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM conversations),
newgram AS (SELECT id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM said),
newtf AS (SELECT id, term, count(*) AS n FROM newgram WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
sc AS (SELECT s.id, pri.category, p + coalesce(sum(n * log_likelihood), 0) AS s FROM said s CROSS JOIN pri
  LEFT JOIN newtf ON newtf.id = s.id LEFT JOIN ll ON ll.category = pri.category AND ll.term = newtf.term GROUP BY s.id, pri.category, p)
SELECT id, arg_max(category, s) AS predicted_category FROM sc GROUP BY id""")
def score_new_feedback(spark, folder):
    scorer = classify.Scorer(_vocabulary(spark, folder, "count"), {"category": _bayes(spark, folder)})
    talk = table(spark, folder, "conversations")
    return scorer(talk.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text"), "id", "text")


@query("feature_importance", "L6 M3")
def feature_importance(spark, folder):
    vocabulary = _vocabulary(spark, folder, "count")
    found = classify.train(_vectors(spark, folder, "count"), "category", "random_forest")
    return classify.feature_importance(_docs(spark, folder), found, vocabulary, 20)


def _lda(spark, folder):
    vectors = _vectors(spark, folder, "count", (1, 1))
    return fitted(spark, folder, "lda", lambda: topics.fit_lda(vectors, K))


def _weights(spark, folder):
    return topics.topic_terms(spark, _lda(spark, folder), _vocabulary(spark, folder, "count", (1, 1)))


@query("lda_topics", "C1 C7 L4 X16")
def lda_topics(spark, folder):
    return store.topic_rows(topics.topic_words(_weights(spark, folder), 10), "lda")


@query("lda_distribution", "C3 C4 C15")
def lda_distribution(spark, folder):
    found = topics.topic_distribution(_lda(spark, folder), _vectors(spark, folder, "count", (1, 1)), "doc_id")
    return topics.wide_distribution(found, "doc_id", K)


@query("lda_distribution_long", "C3 C8")
def lda_distribution_long(spark, folder):
    found = topics.topic_distribution(_lda(spark, folder), _vectors(spark, folder, "count", (1, 1)), "doc_id")
    return topics.long_distribution(found, "doc_id")


@query("topic_samples", "L5 C4")
def topic_samples(spark, folder):
    found = topics.topic_distribution(_lda(spark, folder), _vectors(spark, folder, "count", (1, 1)), "doc_id")
    named = found.select("doc_id", topics.dominant_topic(F.col("probabilities")).alias("topic"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return clusters.first_members(docs, named, "doc_id", "topic", 3)


@query("topic_evaluation", "E10 E11 C6")
def topic_evaluation(spark, folder):
    docs, model = _docs(spark, folder), _lda(spark, folder)
    found = topics.topic_words(_weights(spark, folder), 20).orderBy("topic").collect()
    lists = [row["words"] for row in found]
    counts = topics.window_counts(docs, tx.word_tokens(F.col("text")), sorted({w for ws in lists for w in ws}))
    values = topics.coherence(counts, lists)
    perplexity = model.logPerplexity(_vectors(spark, folder, "count", (1, 1)))
    out = [(i, ", ".join(ws[:10]), v, perplexity) for i, (ws, v) in enumerate(zip(lists, values))]
    return spark.createDataFrame(out, "topic int, top_words string, coherence double, log_perplexity double")


def _completed(spark, folder):
    talk = table(spark, folder, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    return topics.complete_texts(_lda(spark, folder), talk, "id", "text", _vocabulary(spark, folder, "count", (1, 1)))


@query("perplexity_of_new_texts", "E11")
def perplexity_of_new_texts(spark, folder):
    """Topics of the documents on conversations, which the model has not seen."""
    return topics.perplexity(_completed(spark, folder))


@query("completed_texts", "E11", f"""
WITH tok AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
vocab AS (SELECT term FROM tok GROUP BY term ORDER BY count(*) DESC, term LIMIT {TERMS}),
said AS (SELECT conv_id * 100000 + turn AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM conversations),
odd AS (SELECT id, unnest(list_filter(t, lambda w, i: i % 2 = 0)) AS term FROM said)
SELECT id, count(*)::BIGINT AS n_words, true AS is_probability FROM odd WHERE term IN (SELECT term FROM vocab) GROUP BY id""")
def completed_texts(spark, folder):
    """The words that are scored; every one has a chance below 1."""
    return _completed(spark, folder).select("id", "n_words", (F.col("log_likelihood") < 0).alias("is_probability"))


@query("best_topic_count", "C5 C6")
def best_topic_count(spark, folder):
    vectors = _vectors(spark, folder, "count", (1, 1))
    _, _, table_ = topics.find_topic_count(
        vectors, _docs(spark, folder), tx.word_tokens(F.col("text")), _vocabulary(spark, folder, "count", (1, 1)),
        start=2, limit=11, step=2,
    )
    return table_


def _nmf(spark, folder):
    def make():
        vocabulary = _vocabulary(spark, folder, "count", (1, 1))
        return nmf.fit_nmf(_vectors(spark, folder, "count", (1, 1)), len(vocabulary.terms), k=K)

    return fitted(spark, folder, "nmf", make)


@query("nmf_topics", "C2 L4")
def nmf_topics(spark, folder):
    weights = topics.topic_terms(spark, _nmf(spark, folder), _vocabulary(spark, folder, "count", (1, 1)))
    return topics.top_terms_per_topic(weights, 10)


@query("nmf_reduction", "C14")
def nmf_reduction(spark, folder):
    return nmf.nmf_weights(_nmf(spark, folder), _vectors(spark, folder, "count", (1, 1)))


def _points(spark, folder):
    rows_ = table(spark, folder, "embeddings")
    return rows_.select("vec_id", "label", features.dense_vector("embedding").alias("features"))


@query("kmeans_clusters", "C9 C12 C17")
def kmeans_clusters(spark, folder):
    return clusters.cluster(_points(spark, folder), "vec_id", "kmeans", K)


@query("hierarchical_clusters", "C10 C12")
def hierarchical_clusters(spark, folder):
    return clusters.cluster(_points(spark, folder), "vec_id", "hierarchical", K)


@query("ward_merges", "C10")
def ward_merges(spark, folder):
    """The merges of Ward's linkage over the embeddings, lowest first."""
    points = table(spark, folder, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return ward.fit_ward(points, "v").merge_table(points)


@query("svd_reduction", "C13")
def svd_reduction(spark, folder):
    return reduction.truncated_svd(_vectors(spark, folder), len(_vocabulary(spark, folder).terms), k=50)


@query("pca_coordinates", "C16")
def pca_coordinates(spark, folder):
    return reduction.pca(_points(spark, folder), keep=["vec_id", "label"], k=2)


def _reduced(spark, folder):
    reduced = reduction.truncated_svd(_vectors(spark, folder), len(_vocabulary(spark, folder).terms), k=50)
    return reduced.select("doc_id", "reduced", features.dense_vector("reduced").alias("features"))


def _clustered(spark, folder):
    reduced = _reduced(spark, folder)
    found = fitted(spark, folder, "text clusters", lambda: clusters.fit_kmeans(reduced, K))
    return found.transform(reduced).select("doc_id", "reduced", F.col("prediction").cast("int").alias("cluster"))


@query("text_cluster_scores", "C13 C9 E6 E7 E8 E9")
def text_cluster_scores(spark, folder):
    return clusters.evaluate_clustering(_clustered(spark, folder), "doc_id", "cluster", "reduced", exact=False)


@query("combined_analysis", "C18 A8 A9 A10")
def combined_analysis(spark, folder):
    vectors = _vectors(spark, folder, "count", (1, 1))
    topic = topics.topic_distribution(_lda(spark, folder), vectors, "doc_id").select(
        "doc_id", topics.dominant_topic(F.col("probabilities")).alias("topic")
    )
    labels = labelled_documents(spark, folder).select(
        "doc_id", F.col("lang").alias("category"), F.when(F.col("quality") == 1, "Positive").otherwise("Negative").alias("sentiment")
    )
    joined = labels.join(topic, "doc_id").join(_clustered(spark, folder).select("doc_id", "cluster"), "doc_id").cache()
    parts = []
    for a in ("topic", "cluster"):
        for b in ("sentiment", "category"):
            long = stats.melt(stats.crosstab_fractions(joined, a, b), [a], "label", "share")
            parts.append(long.select(F.lit(f"{a} by {b}").alias("table"), F.col(a).cast("string").alias("group"), "label", "share"))
    return reduce(DataFrame.unionByName, parts)


@query("batch_analysis", "M1 M3 M7 C1 C13 C9 E6")
def batch_analysis(spark, folder):
    """The whole flow: features, two classifiers, topics, clusters and their scores."""
    vectors = _vectors(spark, folder)
    train, test = rows.split_rows(vectors, "doc_id")
    parts = []
    for label, model, point in (
        ("sentiment", "logistic_regression", {}), ("category", "random_forest", {}),
    ):
        scored, _ = classify.evaluate(classify.train(train, label, model, **point), test, label)
        wide = scored.select("accuracy", "f1_weighted")
        parts.append(wide.unpivot([], ["accuracy", "f1_weighted"], "metric", "value").withColumn("step", F.lit(label)))
    score = clusters.evaluate_clustering(_clustered(spark, folder), "doc_id", "cluster", "reduced", exact=False)
    score = score.select(F.col("n_clusters").cast("double").alias("n_clusters"), "silhouette_sq")
    parts.append(score.unpivot([], score.columns, "metric", "value").withColumn("step", F.lit("clusters")))
    sizes = topics.topic_words(_weights(spark, folder), 10).select(
        F.concat(F.lit("words of topic "), (F.col("topic") + 1).cast("string")).alias("metric"),
        F.size("words").cast("double").alias("value"), F.lit("topics").alias("step"),
    )
    return reduce(DataFrame.unionByName, [*parts, sizes]).select("step", "metric", "value")
