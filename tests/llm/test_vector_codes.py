"""Vector codes against plain loops."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtide.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, n_parts=16, n_entries=64, rounds=2, scale=256):
    """(vec_id, code, error, label_error) by comparing every part with every entry, and the hash of the codebooks."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(v) for _, v, _ in kept] + [1]) // n_parts)
    kept = [(i, v + [0] * (n_parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:n_entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(n_parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = [[] for _ in book]
            for _, v, _ in kept:
                members[nearest(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for e, m in zip(book, members)]
    out = []
    for i, v, label in kept:
        found = [nearest(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, c, e, total[label]) for i, c, e, label in out], hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("code"), F.lit("x").alias("error"))
    got = vector_codes.compress_with_errors(df.repartition(3), **settings).collect()
    want, digest = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], w) for i, v, w in rows], **settings)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} <= {digest}
    return got


def test_random_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=64)], int(rng.integers(0, 3)) or None) for i in rng.permutation(150)]
    assert len(check(spark, rows)) == 150


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [nan] * 4, 1), (3, [None, 1.0], 1), (4, [inf, 1.0], 2), (5, [], None), (6, [0.5, -0.001], None),
            (6, [0.5, -0.001], None), (7, [1.0] * 5, 2), (None, [0.25] * 3, 2), (8, [-1.0] * 8, 2)]
    assert len(check(spark, rows, n_parts=2, n_entries=3)) == 6
    assert check(spark, [(1, None, 1)]) == [] and check(spark, []) == []


def test_ties_and_repeats(spark):
    rows = [(i, [float(i % 2), 0.0, float(i % 3), 1.0], 0) for i in range(40)]
    check(spark, rows, n_parts=2, n_entries=8, scale=1.0)


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress_with_errors(spark.createDataFrame([(1, [1e30], 1)], SCHEMA)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([2, 40, 5000]))
def test_search_is_exact(width, n, seed, spread):
    rng = np.random.default_rng(seed)
    books = vector_codes.Codebooks(rng.integers(-spread, spread, (3, n, width)), 1.0)
    parts = rng.integers(-spread, spread, (50, 3, width))
    entry, distance, looked = books.nearest(parts)
    all_ = ((parts[:, :, None] - books.entries[None]) ** 2).sum(axis=3)
    assert (distance == all_.min(axis=2)).all() and (entry == all_.argmin(axis=2)).all() and looked.max() <= n


def test_search_looks_at_few_entries():
    rng = np.random.default_rng(0)
    books = vector_codes.Codebooks(rng.integers(-500, 500, (16, 64, 4)), 1.0)
    assert books.nearest(rng.integers(-500, 500, (500, 16, 4)))[2].mean() < 40


def test_round_trip(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=64)], 0) for i in range(80)], SCHEMA)
    books = vector_codes.train(df)
    out = vector_codes.compress(df, books)
    rows = out.select("embedding", "compressed.error", vector_codes.decompress("compressed.code", books).alias("near")).collect()
    for r in rows:
        gap = np.floor(256 * np.asarray(r["embedding"])) - 256 * np.asarray(r["near"])
        assert (gap**2).sum() == r["error"]
    assert pa.types.is_binary(out.select("compressed.code").toArrow()["code"].type)
