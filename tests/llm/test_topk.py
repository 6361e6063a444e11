"""Exact top-k against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxtide.llm.topk import exact_top_k

SCHEMA = "vec_id bigint, embedding array<double>, id string, v int, q string, score double"


def brute(rows, k, scale=64):
    def whole(v):
        if v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            return None
        return [math.floor(x * scale) for x in v]

    one = {}
    for r in rows:
        v = whole(r[1])
        if r[0] is not None and v is not None and (r[0] not in one or list(r[1]) < list(one[r[0]][1])):
            one[r[0]] = v, r[1]
    one = {i: v for i, (v, _) in one.items()}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = set()
    for i, a in one.items():
        if i % 5 == 0:
            scores = sorted((-clip(sum(x * y for x, y in zip(a, b, strict=False))), j) for j, b in one.items() if j != i)
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)}
    return out


def found(spark, rows, k=4, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], SCHEMA)
    return {tuple(r) for r in exact_top_k(df, F.col("vec_id") % 5 == 0, k=k, **options).collect()}


SMALL = {"query_rows": 4, "bucket_rows": 9, "seed_rows": 6}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_products(spark, seed):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = []
    for i in range(120):
        c, stretch = rng.choice(centers), rng.choice([0.1, 1, 1, 3])
        rows.append((i, [stretch * (x + rng.gauss(0, 0.2)) for x in c]))
    assert found(spark, rows, **SMALL) == brute(rows, 4)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(12)]  # ties
    rows += [(20, None), (21, [1.0, None]), (25, [float("nan"), 1.0]), (26, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(30, [2.0, 2.0]), (30, [2.0, 2.0]), (30, [1.0, 9.0]), (35, []), (40, [0.0, 0.0]), (41, [-3.0, -1.0]), (42, [1.0, 2.0, 3.0])]
    assert found(spark, rows, **SMALL) == brute(rows, 4)


def test_large_components_are_exact(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, -3.0]), (2, [1e9 + 0.25, 2.0]), (3, [-1e15, 1.0]), (5, [1e30, 0.0]), (6, [1e150, 1.0])]
    assert found(spark, rows, **SMALL) == brute(rows, 4)


def test_fewer_candidates_than_k_and_empty_table(spark):
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 64 * 128)}
    assert found(spark, []) == set()
    assert found(spark, [(0, None)]) == set()


def test_buckets_out_of_reach_are_not_copied(spark):
    """Long vectors and many short ones: no query needs the short ones, so they meet no block."""
    rng = random.Random(9)
    around = lambda r: (lambda v: [r * x / math.hypot(*v) for x in v])([rng.gauss(0, 1) for _ in range(4)])
    rows = [(i, around(50 + i % 7)) for i in range(60)] + [(100 + i, around(0.5)) for i in range(300)]
    assert found(spark, rows, **SMALL | {"seed_rows": 60}) == brute(rows, 4)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    plan = exact_top_k(df, F.col("vec_id") % 5 == 0, k=4, **SMALL | {"seed_rows": 60})
    hits = [(r["query_id"], r["vec_id"]) for r in plan.collect()]
    assert len(hits) == 4 * 72 and not [1 for _, v in hits if v >= 100]
