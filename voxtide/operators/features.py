"""Bag-of-words features.

A vocabulary is at most `max_features` terms and is known to the driver; counting the
terms of a document then happens within its row, so that vectorising moves no text
between executors. Words are cut by Spark and counted as numbers, a batch of texts at a
time: n-grams are never built as strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.text import ngrams, word_tokens

METHODS = ("tfidf", "count", "binary")


@dataclass
class Vocabulary:
    """Terms in alphabetical order with, for TF-IDF, their inverse document frequency."""

    terms: list[str]
    ngram_range: tuple[int, int] = (1, 2)
    method: str = "count"
    idf: list[float] = field(default_factory=list)


def terms_of(text: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    if tuple(ngram_range) == (1, 1):
        return word_tokens(text)
    # The one-element array binds the tokens to a name, so that they are cut once.
    return F.flatten(F.transform(F.array(word_tokens(text)), lambda t: ngrams(t, *ngram_range)))


def term_totals(docs: DataFrame, text: str, ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """Corpus frequency of every term (counts are combined before the shuffle)."""
    if tuple(ngram_range) == (1, 1):
        return _word_totals(docs, text)
    return docs.select(F.explode(terms_of(F.col(text), ngram_range)).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("total")
    )


def _word_totals(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = pc.value_counts(batch.column(0).flatten())
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["term", "n"])

    parts = docs.select(word_tokens(F.col(text)).alias("words")).mapInArrow(run, "term string, n bigint")
    return parts.groupBy("term").agg(F.sum("n").alias("total"))


def _best(totals: DataFrame, n: int) -> list[tuple[int, str]]:
    """(−total, term) of the n most frequent terms."""
    return [(-r["total"], r["term"]) for r in totals.orderBy(F.desc("total"), F.asc("term")).limit(n).collect()]


def most_frequent(
    docs: DataFrame, text: str, max_features: int = 5000, ngram_range: tuple[int, int] = (1, 2)
) -> list[tuple[str, int]]:
    """The most frequent terms with their totals, ties by term.

    An n-gram is at most as frequent as each of its words, so once `max_features` words
    are known, n-grams with a rarer word cannot get in: they are not counted at all.
    This keeps the many one-off n-grams of a large corpus out of the shuffle.
    """
    low, high = ngram_range
    if low > 1 or high == 1:
        return [(term, -n) for n, term in _best(term_totals(docs, text, ngram_range), max_features)]
    words = _best(term_totals(docs, text, (1, 1)), 2 * max_features)
    bar = words[max_features - 1][0] if len(words) > max_features else 0
    candidates = [term for n, term in words if n <= bar]
    if bar == 0 or len(candidates) == len(words):  # few words, or too many equally rare ones
        longer = _best(term_totals(docs, text, (2, high)), max_features)
    else:
        longer = [found for n in range(2, high + 1) for found in _best_grams(docs, text, n, sorted(candidates), max_features)]
    return [(term, -n) for n, term in sorted(words + longer)[:max_features]]


def _coded(tokens: pa.Array, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of every token of a batch: the number of its text, and the place of its word among `words` (−1: not there)."""
    flat = tokens.flatten()
    text = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    code = pc.index_in(flat, value_set=pa.array(words, type=flat.type))
    return text, pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _best_grams(docs: DataFrame, text: str, n: int, words: Sequence[str], most: int) -> list[tuple[int, str]]:
    """(−total, term) of the most frequent n-grams made of the given words (sorted, at most 2 · max_features).

    An n-gram is numbered by the places of its words. A blank sorts before all that a word is made of,
    so that ties by number are ties by term.
    """
    size = len(words)
    if size**n >= 2**63:  # too long to be numbered: counted as text
        listed = terms_of(F.col(text), (n, n))
        known = docs.sparkSession.createDataFrame(pd.DataFrame({"_word": words}), "_word string")
        grams = docs.select(F.explode(listed).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
        for i in range(n):
            grams = grams.join(F.broadcast(known), F.split("term", " ")[i] == F.col("_word"), "left_semi")
        return _best(grams, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, code = _coded(batch.column(0), words)
            starts = max(len(code) - n + 1, 0)
            gram, known = np.zeros(starts, dtype=np.int64), owner[:starts] == owner[n - 1 :]
            for k in range(n):
                part = code[k : k + starts]
                gram, known = gram * size + part, known & (part >= 0)
            found, count = np.unique(gram[known], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count)], names=["gram", "n"])

    parts = docs.select(word_tokens(F.col(text)).alias("words")).mapInArrow(run, "gram bigint, n bigint")
    totals = parts.groupBy("gram").agg(F.sum("n").alias("total"))
    out = []
    for row in totals.orderBy(F.desc("total"), F.asc("gram")).limit(most).collect():
        places = [row["gram"] // size**k % size for k in reversed(range(n))]
        out.append((-row["total"], " ".join(words[i] for i in places)))
    return out


def top_terms(
    docs: DataFrame, text: str, max_features: int = 5000, ngram_range: tuple[int, int] = (1, 2)
) -> DataFrame:
    """`most_frequent` as a table (term, total)."""
    found = most_frequent(docs, text, max_features, ngram_range)
    frame = pd.DataFrame({"term": [t for t, _ in found], "total": [n for _, n in found]})
    return docs.sparkSession.createDataFrame(frame, "term string, total bigint")


def fit_vocabulary(
    docs: DataFrame, text: str, method: str = "tfidf", max_features: int = 5000,
    ngram_range: tuple[int, int] = (1, 2),
) -> Vocabulary:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}; choose from {', '.join(METHODS)}")
    terms = [term for term, _ in most_frequent(docs, text, max_features, ngram_range)]
    vocabulary = Vocabulary(sorted(terms), ngram_range, method)
    if method == "tfidf":
        vocabulary.idf = inverse_document_frequency(docs, text, vocabulary)
    return vocabulary


def entries(vector: str, key: str, df: DataFrame) -> DataFrame:
    """(key, index, value) rows of a sparse vector column."""
    raw = F.unwrap_udt(vector)
    zipped = F.arrays_zip(raw["indices"].alias("index"), raw["values"].alias("value"))
    return df.select(key, F.inline(zipped))


@dataclass(frozen=True)
class _Grams:
    """The terms of a vocabulary as numbers of their words.

    Every beginning of a term has a number: that of one word is its place, that of a longer one its place
    among the `keys` of its length (number of the shorter beginning · words + last word, sorted).
    """

    words: list[str]
    keys: list[np.ndarray]  # by length, from 2 words
    columns: list[np.ndarray]  # by length, from 1 word: column of the term, −1 for what only begins terms
    width: int

    @staticmethod
    def of(terms: Sequence[Sequence[str]]) -> _Grams:
        words = sorted({w for term in terms for w in term})
        place = {w: i for i, w in enumerate(words)}
        column = {tuple(place[w] for w in term): i for i, term in enumerate(terms)}
        begun = sorted({gram[: k + 1] for gram in column for k in range(len(gram))} | {(i,) for i in range(len(words))})
        keys, columns, number = [], [], {}
        for length in range(1, max(map(len, begun), default=1) + 1):
            grams = [g for g in begun if len(g) == length]
            if length > 1:
                keys.append(np.array([number[g[:-1]] * len(words) + g[-1] for g in grams], dtype=np.int64))
            number = {g: i for i, g in enumerate(grams)}
            columns.append(np.array([column.get(g, -1) for g in grams], dtype=np.int64))
        return _Grams(words, keys, columns, len(terms))

    def cells(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """text · width + column of all terms found, sorted, and how often."""
        owner, code = _coded(tokens, self.words)
        here, found = code, []
        for length, column in enumerate(self.columns, 1):
            if length > 1:
                keys, last = self.keys[length - 2], code[length - 1 :]
                key = here[: len(last)] * len(self.words) + last
                at = np.searchsorted(keys, key).clip(max=len(keys) - 1)
                inside = (here[: len(last)] >= 0) & (last >= 0) & (owner[: len(last)] == owner[length - 1 :])
                here = np.where(inside & (keys[at] == key), at, -1)
            begins = np.flatnonzero(here >= 0)
            term = column[here[begins]]
            found.append((owner[begins] * self.width + term)[term >= 0])
        return np.unique(np.concatenate(found), return_counts=True)


def _count_terms(df: DataFrame, tokens: Column, grams: _Grams, binary: bool, output: str) -> DataFrame:
    """Add a sparse vector with the count of every term in an array column of words."""

    def run(tokens: pa.Array) -> pa.Array:
        n = len(tokens)
        cells, counts = grams.cells(tokens)
        ends = np.searchsorted(cells, np.arange(n + 1) * grams.width).astype(np.int32)
        values = np.ones(len(cells)) if binary else counts.astype(np.float64)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(n, dtype=np.int8)), pa.array(np.full(n, grams.width, dtype=np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((cells % grams.width).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
            ], names=["type", "size", "indices", "values"],
        )

    counted = F.arrow_udf(run, VectorUDT())(tokens)
    return df.withColumn(output, counted.alias(output, metadata={"ml_attr": {"num_attrs": grams.width}}))


def count_listed(df: DataFrame, terms: str, vocabulary: Vocabulary, output: str) -> DataFrame:
    """A sparse vector with the count of every known term in an array column."""
    return _count_terms(df, F.col(terms), _Grams.of([[t] for t in vocabulary.terms]), vocabulary.method == "binary", output)


def _counted(docs: DataFrame, text: str, vocabulary: Vocabulary, output: str) -> DataFrame:
    grams = _Grams.of([t.split(" ") for t in vocabulary.terms])
    return _count_terms(docs, word_tokens(F.col(text)), grams, vocabulary.method == "binary", output)


def inverse_document_frequency(docs: DataFrame, text: str, vocabulary: Vocabulary) -> list[float]:
    """ln((1 + n) / (1 + df)) + 1 per term."""
    if not vocabulary.terms:
        return []
    return inverse_frequency_of_counted(_counted(docs.select(text), text, vocabulary, "_v"), "_v", len(vocabulary.terms))


def inverse_frequency_of_counted(counted: DataFrame, vector: str, width: int) -> list[float]:
    """As `inverse_document_frequency`, from vectors with the counts of the terms."""
    every = F.concat(F.array(F.lit(-1)), F.unwrap_udt(vector)["indices"])  # −1 counts the documents
    df = counted.select(F.explode(every).alias("index")).groupBy("index").count()
    found = {row["index"]: row["count"] for row in df.collect()}
    return [math.log((1 + found[-1]) / (1 + found[i])) + 1 for i in range(width)]


def weigh(counted: DataFrame, vector: str, vocabulary: Vocabulary, output: str) -> DataFrame:
    """Counts of the terms as TF-IDF of length 1."""
    scaling = ElementwiseProduct(scalingVec=Vectors.dense(vocabulary.idf), inputCol=vector, outputCol="_tfidf")
    unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol=output)
    return unit.transform(scaling.transform(counted).drop(vector)).drop("_tfidf")


def vectorize(
    docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, keep: Sequence[str] = (), output: str = "features"
) -> DataFrame:
    """One row per document with a sparse vector: counts, 1s, or TF-IDF of length 1.

    A document without any known term gets the zero vector.
    """
    if not vocabulary.terms:
        raise ValueError("empty vocabulary: no text holds a word of two characters")
    narrow = docs.select(key, text, *keep)
    if vocabulary.method != "tfidf":
        return _counted(narrow, text, vocabulary, output).select(key, *keep, output)
    counted = _counted(narrow, text, vocabulary, "_tf")
    return weigh(counted, "_tf", vocabulary, output).select(key, *keep, output)


def term_table(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The vocabulary as a table (index, term)."""
    frame = pd.DataFrame({"index": range(len(vocabulary.terms)), "term": vocabulary.terms})
    return docs.sparkSession.createDataFrame(frame, "index int, term string")


def long_terms(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """Features in long form: (key, term, value)."""
    pairs = entries("features", key, vectorize(docs, key, text, vocabulary))
    # At most max_features rows are broadcast.
    return pairs.join(F.broadcast(term_table(docs, vocabulary)), "index").select(key, "term", "value")


def long_features(
    docs: DataFrame, key: str, text: str, method: str = "tfidf", max_features: int = 5000,
    ngram_range: tuple[int, int] = (1, 2),
) -> DataFrame:
    """Fit a vocabulary on the texts and return their features in long form."""
    return long_terms(docs, key, text, fit_vocabulary(docs, text, method, max_features, ngram_range))


def dense_vector(column: str | Column) -> Column:
    """`pyspark.ml` vector of an array column."""
    col = F.col(column) if isinstance(column, str) else column
    return array_to_vector(col.cast("array<double>"))
