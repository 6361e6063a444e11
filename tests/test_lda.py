"""Online LDA against plain loops."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from voxtide.operators import lda, topics
from voxtide.operators.reduce import packed, sparse_columns, sum_of_packed

WIDTH = 30


def plain_shares(chances, counts, alpha):
    """One document, step by step; chances: topics × words."""
    gamma, steps = np.ones(len(alpha)), 0
    while True:
        theta = np.exp(lda.expected_log(gamma))
        moved = theta * (chances @ (counts / (theta @ chances))) + alpha
        steps += 1
        change, gamma = np.abs(moved - gamma).mean(), moved
        if change <= lda.TOLERANCE:
            return gamma, steps


def counted(n=120):
    """Texts of words of one of three kinds and a few of any kind, and an empty one."""
    rng = np.random.default_rng(3)
    kinds = np.full((3, WIDTH), 0.15 / WIDTH)
    for i in range(3):
        kinds[i, i * 10 : i * 10 + 10] += 0.085
    return np.vstack([[rng.multinomial(rng.integers(20, 200), kinds[i % 3]) for i in range(n)], np.zeros((1, WIDTH), dtype=int)])


def vectors(spark, rows, partitions):
    found = [(i, Vectors.sparse(WIDTH, np.flatnonzero(r).tolist(), r[r > 0].astype(float).tolist())) for i, r in enumerate(rows)]
    return spark.createDataFrame(found, ["doc_id", "features"]).repartition(partitions, "doc_id")


def test_series():
    x = np.array([0.05, 0.2, 1.0, 7.5, 4000.0])
    h = 1e-5 * x
    slope = np.array([(math.lgamma(a + b) - math.lgamma(a - b)) / (2 * b) for a, b in zip(x, h)])
    assert lda.log_gamma(x) == pytest.approx([math.lgamma(a) for a in x], abs=1e-7)
    assert lda.digamma(x) == pytest.approx(slope, rel=1e-6)
    assert lda.trigamma(x) == pytest.approx((lda.digamma(x + h) - lda.digamma(x - h)) / (2 * h), rel=1e-5)


def test_alike_topics_take_few_steps():
    """Topics as at the start of a fit: the plain steps creep, the long ones end in a fit that is as good."""
    rng = np.random.default_rng(5)
    lam = rng.gamma(100, 0.01, (5, 400))
    chance, alpha = np.exp(lda.expected_log(lam)), np.full(5, 0.2)
    columns = np.array([rng.permutation(400)[:150] for _ in range(20)])
    counts = rng.geometric(0.3, columns.shape).astype(float)
    words = lda._Words(chance[:, columns].transpose(1, 0, 2).copy(), counts, alpha)
    found, steps = lda.document_shares(words)
    plain = [plain_shares(chance[:, c], n, alpha) for c, n in zip(columns, counts)]
    want, slow = np.array([g for g, _ in plain]), max(n for _, n in plain)
    assert slow > 1000 and steps < slow / 4
    assert (words.fit(found) > words.fit(want) - 0.5).all() and words.fit(found).sum() > words.fit(want).sum() - 0.1
    assert np.abs(words.step(found) - found).mean(axis=1).max() <= lda.TOLERANCE
    assert found.sum(axis=1) == pytest.approx(counts.sum(axis=1) + alpha.sum())


def some_words(seed, n=300, wide=80):
    rng = np.random.default_rng(seed)
    chance = np.exp(lda.expected_log(rng.gamma(1, 1, (4, 500))))
    columns = np.array([rng.permutation(500)[:wide] for _ in range(n)])
    return chance[:, columns].transpose(1, 0, 2).copy(), rng.geometric(0.3, columns.shape).astype(float), np.full(4, 0.25)


def test_large_arrays_are_used_again():
    words = lda._Words(*some_words(1))
    want, _ = lda.document_shares(words)
    lda.document_shares(lda._Words(*some_words(2)))  # others in between
    tracemalloc.start()
    found, _ = lda.document_shares(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == want).all()
    assert most < words.counts.nbytes


def test_step_of_better_is_the_step_from_what_fits_better():
    words = lda._Words(*some_words(3))
    gamma = words.step(np.ones((300, 4)))
    other = np.random.default_rng(4).permuted(gamma, axis=1)
    other[::2] = words.step(words.step(gamma))[::2]
    better = words.fit(other) > words.fit(gamma)
    assert 0 < better.sum() < len(better)
    assert words.step_of_better(gamma, other) == pytest.approx(words.step(np.where(better[:, None], other, gamma)), rel=1e-9)


def test_packed_counts_are_narrow(spark):
    """Counts and columns take few bytes between the passes, and come back as they were."""
    rows = np.random.default_rng(6).integers(1, 9, (400, WIDTH)).astype(float)
    rows[7, 3], rows[9, 4] = 300, 70_000
    for value in (0, 0.5):
        parts = packed(sparse_columns(vectors(spark, rows[:9] + value, 1), "features", []))
        found = sum_of_packed(parts, WIDTH, lambda out, block: np.add(out, block.dense().sum(axis=0), out=out), (1, WIDTH))
        assert (found[0] == (rows[:9] + value).sum(axis=0)).all()
    parts = packed(sparse_columns(vectors(spark, rows, 1), "features", []))
    found = sum_of_packed(parts, WIDTH, lambda out, block: np.add(out, block.dense().sum(axis=0), out=out), (1, WIDTH))
    assert (found[0] == rows.sum(axis=0)).all()
    small = packed(sparse_columns(vectors(spark, np.minimum(rows, 9), 1), "features", []))
    assert sum(map(len, small.collect())) < 3 * rows.size


@pytest.mark.parametrize("learn_alpha", [False, True])
def test_fit_is_the_plain_loop(spark, learn_alpha):
    rows, k, passes = counted(), 3, 4
    model = topics.fit_lda(vectors(spark, rows, 3), k, passes, learn_alpha=learn_alpha)
    lam = topics.fit_lda(vectors(spark, rows, 2), k, 0).topicsMatrix().toArray().T  # as Spark starts
    alpha = np.full(k, 1 / k)
    for step in range(1, passes + 1):
        rate, beta = (10 + step) ** -0.7, np.exp(lda.expected_log(lam))
        total, mean = np.zeros_like(lam), []
        for row in rows[rows.sum(axis=1) > 0]:
            at = np.flatnonzero(row)
            gamma = lda.document_shares(lda._Words(beta[:, at][None], row[at][None], alpha))[0][0]
            theta = np.exp(lda.expected_log(gamma))
            total[:, at] += theta[:, None] * (row[at] / (theta @ beta[:, at])) * beta[:, at]
            mean.append(lda.expected_log(gamma))
        lam = (1 - rate) * lam + rate * (total + 1 / k)
        if learn_alpha:
            alpha = lda._new_alpha(alpha, np.mean(mean, axis=0), len(mean), rate)
    got = model.topicsMatrix().toArray().T
    assert got == pytest.approx(lam, rel=1e-6)
    assert model.estimatedDocConcentration().toArray() == pytest.approx(alpha, rel=1e-6)
    assert (model.getK(), model.getMaxIter(), model.vocabSize()) == (k, passes, WIDTH)
    assert math.isfinite(model.logPerplexity(vectors(spark, rows, 2)))


def test_topics_do_not_hang_on_partitions(spark):
    """Every document counts once in every pass, wherever it lies."""
    rows = counted(60)
    one, many = (topics.fit_lda(vectors(spark, rows, n), 3, 3).topicsMatrix().toArray() for n in (1, 7))
    assert one == pytest.approx(many, rel=1e-6)


def test_texts_without_known_words(spark):
    """The topics stay as they started."""
    nothing = vectors(spark, np.zeros((4, WIDTH), dtype=int), 2)
    assert topics.fit_lda(nothing, 3, 2).topicsMatrix().toArray() == pytest.approx(topics.fit_lda(nothing, 3, 0).topicsMatrix().toArray())
