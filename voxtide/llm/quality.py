"""Ordinal quality classifier: a cumulative-link regression on graded ratings.

A text is a bag of hashed features: its distinct words, and tokens for its shape (shares of capitals,
symbols, bars, repeated words, ...). One weight per feature is shared by all grades; ordered thresholds
t_0 < t_1 < ... give P(grade <= k) = 1 / (1 + exp(score - t_k)). The weights are fitted on a bounded
sample of rated rows with an L1 penalty, so that words that say nothing weigh nothing.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import Recent, batch_udf, kept, plain_words, small_batches, struct_rows, utf8

BITS = 18
STEM = 5  # bytes
SAMPLE_ROWS = 12_000  # rated rows the model is fitted on
PENALTY, RATE = 1.0, 0.3
STEPS = 96_000  # rows looked at in whole passes over the sample
EVIDENCE = 4.0  # standard errors; below that a feature is noise
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-")


def bucket(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) & (1 << BITS) - 1


def _tenth(part: int, whole: int) -> int:
    """0 for none at all, then 1 to 10 by tenths, with finer steps below a tenth."""
    if not part or not whole:
        return 0
    share = part / whole
    return 1 if share < 0.005 else 2 if share < 0.02 else 3 if share < 0.05 else 4 + min(9, int(share * 10))


def features(text: bytes) -> set[bytes]:
    """Distinct words, their first bytes (stems), and shape tokens that begin with a blank."""
    words = plain_words(text)
    out = set(words)
    n_words = len(out)
    out.update([b"%b*" % w[:STEM] for w in out if len(w) > STEM])
    letters = len(text.translate(None, bytes(range(65))))
    n_lines = text.count(b"\n") + 1
    shape = (
        ("caps", _tenth(len(text) - len(text.translate(None, bytes(range(65, 91)))), letters)),
        ("symbols", _tenth(len(text) - len(text.translate(None, SYMBOLS)), len(text))),
        ("digits", _tenth(len(text) - len(text.translate(None, b"0123456789")), len(text))),
        ("bars", _tenth(text.count(b"|"), len(words))),
        ("bangs", _tenth(text.count(b"!!"), len(words))),
        ("fresh", _tenth(n_words, len(words))),
        ("lines", _tenth(n_lines, len(words))),
        ("marked", _tenth(sum(text.count(m) for m in (b"###", b"$$$", b"%%%", b"&&&", b"***")), len(words))),
        ("words", min(16, len(words).bit_length())),
        ("length", min(15, len(text) // max(1, len(words)))),
        ("same lines", _tenth(n_lines - len(set(text.split(b"\n"))), n_lines)),
        ("echoes", _tenth(sum(map(eq, words, words[1:])), len(words))),
        ("top word", _tenth(max(Counter(words).values(), default=0), len(words))),
    )
    out.update(b" %s %d" % (name.encode(), value) for name, value in shape)
    return out


@dataclass
class Ordinal:
    """Weights by hashed feature, thresholds between grades, and the grades from the lowest."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and every grade but the highest."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, rate: float = RATE, steps: int = STEPS
) -> Ordinal:
    """Follow-the-regularised-leader steps, row by row, in the given order; rows hold distinct buckets.

    Each weight has a step size of its own and is 0 until the evidence for it exceeds the penalty.
    Only features whose rows' grades lie EVIDENCE standard errors from the mean take part; those of
    more than half the rows are left to the thresholds. Without rows, or with one grade only, all
    weights are 0.
    """
    levels, y = np.unique(grades, return_inverse=True)
    weights = np.zeros(1 << BITS)
    n, k = len(rows), len(levels)
    if k < 2:
        return Ordinal(weights, np.zeros(0), levels.tolist())
    counts = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    lean = np.bincount(np.concatenate(rows), np.repeat((y - y.mean()) / y.std(), [len(r) for r in rows]), 1 << BITS)
    useful = (np.abs(lean) >= EVIDENCE * np.sqrt(np.maximum(counts, 1))) & (counts <= n / 2)
    rows = [r[useful[r]] for r in rows]
    shares = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    cut = np.log(shares / (1 - shares))
    pull, seen, cut_seen = np.zeros(1 << BITS), np.zeros(1 << BITS), np.ones(k - 1)
    for _ in range(-(-steps // n)):
        for at, grade in zip(rows, y.tolist(), strict=True):
            z, q = pull[at], np.sqrt(seen[at])
            w = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((1 + q) / rate))
            score = float(w.sum())
            high = 1.0 if grade == k - 1 else _sigmoid(cut[grade] - score)
            low = 0.0 if grade == 0 else _sigmoid(cut[grade - 1] - score)
            share = max(high - low, 1e-9)
            g = 1 - high - low  # slope of the loss along the score
            grown = seen[at] + g * g
            pull[at] = z + g - (np.sqrt(grown) - q) / rate * w
            seen[at] = grown
            for j, slope in ((grade, -high * (1 - high) / share), (grade - 1, low * (1 - low) / share)):
                if 0 <= j < k - 1:
                    cut_seen[j] += slope * slope
                    cut[j] -= rate * slope / np.sqrt(cut_seen[j])
            cut = np.maximum.accumulate(cut)
    on = np.abs(pull) > penalty
    weights[on] = -(pull[on] - np.sign(pull[on]) * penalty) / ((1 + np.sqrt(seen[on])) / rate)
    return Ordinal(weights, cut, levels.tolist())


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for toxic, 1 for low quality, 2 for good; null where a rating that decides is missing."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def train(docs: DataFrame, rated: DataFrame, id: str = "doc_id", text: str = "text", grade: str = "grade", sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit on the `sample_rows` rated rows whose ids hash lowest; a larger table does not change the bound.

    Rows with a null id, grade or text are left out. An id that is rated more than once counts as
    often as it is rated; the sample holds at most `sample_rows` of them.
    """
    small_batches(docs.sparkSession)
    sample = rated.where(F.col(id).isNotNull() & F.col(grade).isNotNull()).select(F.col(id).alias("rated_id"), F.col(grade).cast("int").alias("grade"))
    sample = sample.orderBy(F.xxhash64("rated_id"), "rated_id", "grade").limit(sample_rows)
    texts = docs.select(F.col(id).alias("rated_id"), utf8(text).alias("body")).where(F.col("body").isNotNull())
    both = texts.join(F.broadcast(sample), "rated_id")  # at most sample_rows narrow rows

    def work(values: list) -> pa.Array:
        return pa.array([sorted({bucket(f) for f in features(v)}) for v in values], pa.list_(pa.int32()))

    seen = both.select("rated_id", "grade", batch_udf(work, "array<int>")("body").alias("f"))
    # a repeated document counts once
    seen = seen.dropDuplicates(["rated_id", "grade", "f"]).orderBy(F.xxhash64("rated_id"), "rated_id", "grade", "f").limit(sample_rows).toArrow()
    return fit_ordinal([np.asarray(f.values) for f in seen["f"]], seen["grade"].to_numpy().astype(np.int64))


FIELDS = [("expected_grade", pa.float64()), ("tail", pa.float64())]


def scored(model: Ordinal, session, at_least: int | None = None):
    """A column function from text bytes to (expected_grade, tail); tail is P(grade >= at_least)."""
    shared = session.sparkContext.broadcast((model.weights, model.thresholds, model.grades))
    key = f"grades {uuid.uuid4().hex}"

    def work(values: list) -> pa.Array:
        weights, thresholds, grades = shared.value
        cache = kept(key, Recent)
        found = [features(v or b"") for v in values]
        for f in cache.missing(x for own in found for x in own):
            cache.now[f] = float(weights[bucket(f)])
        get = cache.now.__getitem__
        scores = np.array([sum(map(get, sorted(own))) for own in found])  # one order, one rounding
        cache.turn()
        tails = Ordinal(weights, thresholds, grades).tails(scores)
        steps = np.diff(grades)
        expected = (grades[0] if grades else 0) + (tails * steps).sum(1)
        wanted = grades[-1] if at_least is None and grades else at_least
        over = [k for k in range(len(thresholds)) if grades[k + 1] >= (wanted or 0)]
        sure = len(grades) < 2 or grades[0] >= (wanted or 0)
        tail = np.ones(len(values)) if sure else tails[:, over[0]] if over else np.zeros(len(values))
        return struct_rows(FIELDS, (expected, tail))

    return batch_udf(work, "struct<expected_grade:double,tail:double>")


def grade_texts(docs: DataFrame, model: Ordinal, text: str = "text", column: str = "grading", at_least: int | None = None) -> DataFrame:
    """The documents with a struct column of (expected_grade, tail).

    expected_grade is the mean of the grades under the model; tail the probability of grade
    `at_least` (the highest, if not given) or better; 1 if the model has seen fewer than two grades,
    as it then rejects nothing. Null and empty texts are graded by their shape
    alone. All columns are kept; `column` must be a name of its own. Nothing is shuffled.
    """
    if column in docs.columns:
        raise ValueError(f"column {column} exists already")
    small_batches(docs.sparkSession)
    return docs.withColumn(column, scored(model, docs.sparkSession, at_least)(utf8(text)))
