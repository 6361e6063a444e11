"""Topics: LDA and NMF models, topic tables, coherence, choice of the number of topics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.operators import lda
from voxtide.operators.features import Vocabulary, count_listed, entries, terms_of
from voxtide.operators.nmf import NmfModel
from voxtide.operators.rows import first_per_group

WINDOW = 110  # tokens per sliding window of the coherence measure
STARTS = 65_536  # window starts of a long text handled at a time
TINY = 1e-12


def fit_lda(df: DataFrame, k: int = 5, passes: int = 10, seed: int = 42, features: str = "features",
            learn_alpha: bool = False) -> LDAModel:
    """Online LDA that sees the whole collection `passes` times."""
    return lda.fit(df, k, passes, seed, features, learn_alpha)


def topic_distribution(model: LDAModel, df: DataFrame, key: str) -> DataFrame:
    """(key, probabilities) with the topic shares of each document."""
    scored = model.transform(df)
    return scored.select(key, vector_to_array("topicDistribution").alias("probabilities"))


def long_distribution(distribution: DataFrame, key: str) -> DataFrame:
    return distribution.select(key, F.posexplode("probabilities").alias("topic", "probability"))


def wide_distribution(distribution: DataFrame, key: str, k: int) -> DataFrame:
    """Columns Topic_1 … Topic_k and Dominant_Topic."""
    topics = [F.col("probabilities")[i].alias(f"Topic_{i + 1}") for i in range(k)]
    return distribution.select(key, *topics, dominant_topic(F.col("probabilities")).alias("Dominant_Topic"))


def dominant_topic(weights: Column) -> Column:
    """Name of the first largest entry, counted from 1."""
    at = F.array_position(weights, F.array_max(weights))
    return F.concat(F.lit("Topic_"), at.cast("string"))


def topic_terms(spark: SparkSession, model: LDAModel | NmfModel, vocabulary: Vocabulary) -> DataFrame:
    """Weight of every term in every topic (k × terms rows)."""
    weights = model.components if isinstance(model, NmfModel) else model.topicsMatrix().toArray().T
    k, n = weights.shape
    frame = pd.DataFrame(
        {
            "topic": np.repeat(np.arange(k), n),
            "term": np.tile(np.array(vocabulary.terms, dtype=object), k),
            "weight": np.asarray(weights, dtype=float).ravel(),
        }
    )
    return spark.createDataFrame(frame, "topic int, term string, weight double")


def top_terms_per_topic(weights: DataFrame, n: int = 10, group: str = "topic") -> DataFrame:
    """The n heaviest terms of each topic, ties by term."""
    return first_per_group(weights, group, [F.desc("weight"), F.asc("term")], n)


def topic_words(weights: DataFrame, n: int = 10) -> DataFrame:
    """(topic, words): the top words as one array per topic."""
    ranked = top_terms_per_topic(weights, n)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))  # n rows per topic
    return ranked.groupBy("topic").agg(pairs.alias("p")).select("topic", F.col("p.term").alias("words"))


def window_counts(docs: DataFrame, tokens: Column, words: Sequence[str], window: int = WINDOW) -> DataFrame:
    """Sliding windows that hold each pair of words (a ≤ b; a = b counts the word itself).

    Row (null, null) counts all windows. A text shorter than the window is one window.
    Tasks add up a words × words table over their documents, so that what is shuffled
    does not grow with the texts.
    """
    words = sorted(set(words))
    index = F.create_map(*[part for i, w in enumerate(words) for part in (F.lit(w), F.lit(i))])
    # The hashed membership test spares most tokens the walk through the map.
    coded = F.transform(tokens, lambda t: F.when(t.isin(words), index[t]).otherwise(-1))
    size = len(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        together, windows = np.zeros((size, size), dtype=np.int64), 0
        for batch in batches:
            for codes in batch["codes"]:
                n = len(codes)
                if n == 0:
                    continue
                starts = max(n - window + 1, 1)
                windows += starts
                codes = np.asarray(codes)
                at = np.flatnonzero(codes >= 0)
                for low in range(0, starts, STARTS):
                    high = min(low + STARTS, starts)
                    near = at[(at >= low) & (at <= high + window - 2)]
                    if not len(near):
                        continue
                    present, local = np.unique(codes[near], return_inverse=True)
                    # +1 where a word enters the range of window starts, −1 behind it.
                    edges = np.zeros((high - low + 1, len(present)), dtype=np.int32)
                    np.add.at(edges, (np.maximum(near - window + 1, low) - low, local), 1)
                    np.add.at(edges, (np.minimum(near, high - 1) + 1 - low, local), -1)
                    inside = (np.cumsum(edges[:-1], axis=0) > 0).astype(np.float64)
                    together[np.ix_(present, present)] += (inside.T @ inside).astype(np.int64)
        a, b = np.nonzero(np.triu(together))
        yield pd.DataFrame({"a": a, "b": b, "n": together[a, b]})
        yield pd.DataFrame({"a": [-1], "b": [-1], "n": [windows]})

    counted = docs.select(coded.alias("codes")).mapInPandas(run, "a int, b int, n bigint")
    names = F.array(*[F.lit(w) for w in words])
    added = counted.groupBy("a", "b").agg(F.sum("n").cast("bigint").alias("windows"))
    name = [F.when(F.col(c) >= 0, F.get(names, F.col(c))).alias(f"word_{c}") for c in ("a", "b")]
    return added.select(*name, "windows")


def pair_npmi(counts: DataFrame) -> DataFrame:
    """Normalised pointwise mutual information of the counted pairs."""
    total = counts.where("word_a is null").agg(F.max("windows")).scalar()
    single = counts.where("word_a = word_b")
    a = single.select(F.col("word_a"), F.col("windows").alias("n_a"))
    b = single.select(F.col("word_a").alias("word_b"), F.col("windows").alias("n_b"))
    p, pa, pb = (F.col(c) / F.col("total") for c in ("windows", "n_a", "n_b"))
    value = F.log((p + TINY) / (pa * pb)) / -F.log(p + TINY)
    pairs = counts.where("word_a is not null").join(a, "word_a").join(b, "word_b")
    return pairs.withColumn("total", total).select("word_a", "word_b", "windows", value.alias("npmi"))


def coherence(counts: DataFrame, topics: Sequence[Sequence[str]]) -> list[float]:
    """c_v per topic from window counts of its top words (Röder, Both, Hinneburg 2015)."""
    rows = counts.collect()  # pairs among the top words of k topics
    n = {(r["word_a"], r["word_b"]): r["windows"] for r in rows}
    total = n.get((None, None), 0)
    out = []
    for words in topics:
        words = [w for w in words if (w, w) in n]
        if not words:
            out.append(0.0)
            continue
        single = np.array([n[w, w] for w in words]) / total
        joint = np.array([[n.get((min(a, b), max(a, b)), 0) for b in words] for a in words]) / total
        npmi = np.log((joint + TINY) / np.outer(single, single)) / -np.log(joint + TINY)
        whole = npmi.sum(axis=0)
        length = np.linalg.norm(npmi, axis=1) * np.linalg.norm(whole)
        out.append(float(np.mean(np.where(length > 0, npmi @ whole / np.where(length > 0, length, 1), 0.0))))
    return out


def complete_texts(model: LDAModel, docs: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, n_words, log_likelihood): how well a text's topics, told from half of its words, predict the other half.

    Words at even positions (from 0) give the topic shares, known words at odd positions are scored. A text
    without a known word at an even position has the prior's shares. Texts without a scored word have no row; a
    repeated key adds up. The model has not seen the scored words, so that their perplexity is that of new texts.
    """
    words = terms_of(F.col(text), (1, 1))
    told, rest = F.filter(words, lambda w, i: i % 2 == 0), F.filter(words, lambda w, i: i % 2 == 1)
    counted = docs.select(F.col(key).alias("id"), told.alias("told"), rest.alias("rest"))
    for name, output in (("told", model.getFeaturesCol()), ("rest", "held_out")):
        counted = count_listed(counted, name, vocabulary, output).drop(name)
    prior = np.asarray(model.estimatedDocConcentration().toArray(), dtype=float)
    prior = F.array(*[F.lit(float(a)) for a in np.broadcast_to(prior / prior.sum() if len(prior) > 1 else 1 / model.getK(), model.getK())])
    found = vector_to_array(model.getTopicDistributionCol())
    add = lambda a, b: a + b
    mixed = model.transform(counted).select("id", "held_out", F.when(F.aggregate(found, F.lit(0.0), add) > 0, found).otherwise(prior).alias("shares"))
    mixed = mixed.select(F.struct("id", "shares").alias("told"), "held_out")

    topics = model.topicsMatrix().toArray()
    topics = topics / topics.sum(axis=0)
    frame = pd.DataFrame({"index": range(len(topics)), "topics": topics.tolist()})
    table = docs.sparkSession.createDataFrame(frame, "index int, topics array<double>")
    # at most max_features rows are broadcast
    scored = entries("held_out", "told", mixed).join(F.broadcast(table), "index")
    chance = F.aggregate(F.zip_with(F.col("told.shares"), F.col("topics"), lambda a, b: a * b), F.lit(0.0), add)
    return scored.groupBy(F.col("told.id").alias(key)).agg(
        F.sum("value").cast("bigint").alias("n_words"), F.sum(F.col("value") * F.log(chance)).alias("log_likelihood")
    )


def perplexity(completed: DataFrame) -> DataFrame:
    """One row (n_texts, n_words, perplexity) of scored texts; the perplexity of none is null."""
    return completed.agg(
        F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum("n_words"), F.lit(0)).cast("bigint").alias("n_words"),
        F.exp(-F.sum("log_likelihood") / F.sum("n_words")).alias("perplexity"),
    )


def find_topic_count(
    features: DataFrame, docs: DataFrame, tokens: Column, vocabulary: Vocabulary, start: int = 2, limit: int = 10,
    step: int = 1, passes: int = 10, top: int = 20, seed: int = 42,
) -> tuple[int, LDAModel, DataFrame]:
    """Fit one model per number of topics (`limit` excluded); the first best coherence wins."""
    spark = docs.sparkSession
    kept = features.storageLevel.useMemory or features.storageLevel.useDisk  # by the caller
    features = features if kept else features.cache()
    fitted, lists = [], []
    counts_range = list(range(start, limit, step))
    for k in counts_range:
        model = fit_lda(features, k, passes, seed, learn_alpha=True)
        fitted.append(model)
        found = topic_words(topic_terms(spark, model, vocabulary), top).orderBy("topic").collect()
        lists.append([row["words"] for row in found])
    words = {w for topics in lists for topic in topics for w in topic}
    counts = window_counts(docs, tokens, sorted(words)).cache()  # one pass serves all models
    values = [float(np.mean(coherence(counts, topics))) for topics in lists]
    counts.unpersist()
    if not kept:
        features.unpersist()
    best = values.index(max(values))
    table = spark.createDataFrame(list(zip(counts_range, values)), "n_topics int, coherence double")
    return counts_range[best], fitted[best], table
