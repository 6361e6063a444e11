"""Label classifiers: training, scoring, evaluation, tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.operators import linear, search
from voxtide.operators.features import Vocabulary, term_table, vectorize
from voxtide.operators.metrics import full_report, scores
from voxtide.operators.numbering import modulo, rank_in_groups
from voxtide.session import scratch_path

MODELS = ("logistic_regression", "naive_bayes", "random_forest", "svm")

DEEPEST = 30  # unlimited depth is Spark's deepest tree
TOLERANCE = 1e-4


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k · n_c) per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count()
    n, k = counts.agg(F.sum("count")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, "count", (n / (k * F.col("count"))).alias("weight"))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """Add the balanced class weight of each row; classes are few, so they become literals."""
    table = class_weights(df, label).collect()
    weight = F.lit(None).cast("double")
    for row in table:
        weight = F.when(F.col(label) == row[label], F.lit(row["weight"])).otherwise(weight)
    return df.withColumn("weight", weight)


def _params(model: str, grid_point: dict, rows: int) -> dict:
    """Spark parameters for the usual names: C is the inverse of the summed penalty."""
    out = {}
    if "C" in grid_point:
        out["regParam"] = 1.0 / (grid_point["C"] * max(rows, 1))
    if "alpha" in grid_point:
        out["smoothing"] = float(grid_point["alpha"])
    if "n_estimators" in grid_point:
        out["numTrees"] = int(grid_point["n_estimators"])
    if "max_depth" in grid_point:
        out["maxDepth"] = DEEPEST if grid_point["max_depth"] is None else int(grid_point["max_depth"])
    return out


def make_estimator(model: str, rows: int, classes: int, seed: int = 42, **point) -> Estimator:
    """Estimator with the default hyper-parameters, overridden by `point`."""
    if model == "logistic_regression":
        return LogisticRegression(
            labelCol="label", weightCol="weight", maxIter=1000, tol=TOLERANCE, elasticNetParam=0.0, standardization=False,
            family="multinomial" if classes > 2 else "binomial", **_params(model, {"C": 1.0, **point}, rows),
        )
    if model == "naive_bayes":
        return NaiveBayes(labelCol="label", modelType="multinomial", **_params(model, {"alpha": 1.0, **point}, rows))
    if model == "random_forest":
        return RandomForestClassifier(
            labelCol="label", weightCol="weight", seed=seed, featureSubsetStrategy="sqrt",
            cacheNodeIds=True,  # else every level walks every row down every tree again
            **_params(model, {"n_estimators": 100, "max_depth": None, **point}, rows),
        )
    raise ValueError(f"unknown model type: {model}")


def without_summary(spark: SparkSession, model: Model) -> Model:
    """The model as read back from disk: without its training summary.

    A summary refers to the session and the training rows, and is sent along with the model. What
    the session holds (an observation, for one) may not be serialisable.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    return type(model).load(path)


def train(
    df: DataFrame, label: str, model: str = "logistic_regression", seed: int = 42, **point
) -> PipelineModel | linear.LinearModel:
    """Fit a classifier on rows with a `features` vector and a text label.

    The result maps vectors to `predicted_<label>`; rows without a label are not used. Support vector
    machines take a `loss`: squared_hinge (unless said otherwise) or hinge.
    """
    if model == "svm":
        return linear.train(df, label, point.get("loss", "squared_hinge"), point.get("C", 1.0))
    rows = with_weights(df.where(F.col(label).isNotNull()), label).select("features", label, "weight")
    rows = rows.withColumn(label, F.col(label).cast("string")).cache()
    try:
        indexer = StringIndexer(
            inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"
        ).fit(rows)
        n = rows.count()
        estimator = make_estimator(model, n, len(indexer.labels), seed, **point)
        indexed = indexer.transform(rows)
        fitted = without_summary(df.sparkSession, estimator.fit(indexed))
        if model == "naive_bayes":
            fitted.setThresholds(_plain_priors(indexed, fitted.getSmoothing()))
    finally:
        rows.unpersist()
    names = IndexToString(inputCol="prediction", outputCol=f"predicted_{label}", labels=indexer.labels)
    return PipelineModel([fitted, names])


def _plain_priors(indexed: DataFrame, smoothing: float) -> list[float]:
    """Thresholds that undo the smoothing of class priors (term counts stay smoothed)."""
    counts = [row["count"] for row in indexed.groupBy("label").count().orderBy("label").collect()]
    n, k = sum(counts), len(counts)
    return [((c + smoothing) / (n + k * smoothing)) / (c / n) for c in counts]


def predict(model: PipelineModel | linear.LinearModel, df: DataFrame, label: str) -> DataFrame:
    """Add `predicted_<label>` and, where the model has one, the winning probability."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        best = F.array_max(vector_to_array("probability"))
        scored = scored.withColumn("confidence", best)
    return scored.drop("rawPrediction", "probability", "prediction")


def evaluate(model: PipelineModel | linear.LinearModel, df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Score row and per-class report on labelled rows."""
    scored = predict(model, df.where(F.col(label).isNotNull()), label)
    scored = scored.select(F.col(label).cast("string").alias("truth"), f"predicted_{label}")
    return scores(scored, "truth", f"predicted_{label}"), full_report(scored, "truth", f"predicted_{label}")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold`: each class is dealt evenly over the folds, whatever its size."""
    ranked = rank_in_groups(df, label, key, "_rank", seed=seed)
    return ranked.withColumn("fold", modulo(F.col("_rank"), folds)).drop("_rank")


def tune(
    df: DataFrame, label: str, key: str, model: str = "logistic_regression",
    grid: dict[str, Sequence] | None = None, folds: int = 5, seed: int = 42,
) -> tuple[dict, float, PipelineModel | linear.LinearModel]:
    """Grid search by weighted F1 over stratified folds; the best setting is fitted on all rows.

    Returns the setting, its mean score and the fitted model. All settings share their passes over the
    rows (see `search`); the default grids are those of `search.GRIDS`.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model type: {model}")
    trials = search.search(df, label, key, [model], None if grid is None else {model: grid}, folds, seed)
    (best,) = search.best_trials(trials)
    return best.point, best.f1, fit_point(df, label, model, best.point, seed)


def fit_point(df: DataFrame, label: str, model: str, point: dict, seed: int = 42) -> PipelineModel | linear.LinearModel:
    """Fit one setting of a search grid on all rows."""
    if model in ("svm", "logistic_regression"):
        classes = df.where(F.col(label).isNotNull()).select(label).distinct().count()
        return linear.train(df, label, search.loss_of(model, point, classes), float(point.get("C", 1.0)))
    return train(df, label, model, seed, **point)


def naive_bayes_likelihoods(df: DataFrame, label: str, model: PipelineModel, vocabulary: Vocabulary,
                            labels: Sequence[str]) -> DataFrame:
    """Log likelihood of every term in every class of a fitted naive Bayes model."""
    theta = model.stages[0].theta.toArray()
    rows = [
        (str(name), int(j), float(theta[i, j])) for i, name in enumerate(labels) for j in range(theta.shape[1])
    ]
    table = df.sparkSession.createDataFrame(rows, f"{label} string, index int, log_likelihood double")
    return table.join(F.broadcast(term_table(df, vocabulary)), "index").drop("index")


def feature_importance(df: DataFrame, model: PipelineModel, vocabulary: Vocabulary, top: int = 20) -> DataFrame:
    """Most important terms of a tree-based model."""
    fitted = model.stages[0]
    if not hasattr(fitted, "featureImportances"):
        raise ValueError("the model has no feature importances")
    weights = fitted.featureImportances
    rows = [(int(i), float(v)) for i, v in zip(weights.indices, weights.values)]
    table = df.sparkSession.createDataFrame(rows, "index int, importance double")
    joined = table.join(F.broadcast(term_table(df, vocabulary)), "index").drop("index")
    return joined.select("term", "importance").orderBy(F.desc("importance"), "term").limit(top)


class Scorer:
    """Fitted vocabulary and classifiers applied to new texts, batch or stream; nothing is refitted."""

    def __init__(self, vocabulary: Vocabulary, models: dict[str, PipelineModel]):
        self.vocabulary, self.models = vocabulary, models

    def __call__(self, df: DataFrame, key: str, text: str) -> DataFrame:
        kept = [c for c in df.columns if c not in (key, text)]
        out = vectorize(df, key, text, self.vocabulary, kept)
        for label, model in self.models.items():
            out = predict(model, out, label).drop("confidence")
        return out.drop("features")
