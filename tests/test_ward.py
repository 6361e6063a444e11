"""Ward's linkage against comparing all pairs after every merge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.operators import features, ward


def plain(points):
    """Heights of all merges, and the clusters left after each of them."""
    clusters = [[i] for i in range(len(points))]
    heights, states = [], []
    while len(clusters) > 1:
        best = None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                x, y = points[clusters[a]], points[clusters[b]]
                gap = 2 * len(x) * len(y) / (len(x) + len(y)) * ((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum()
                if best is None or gap < best[0]:
                    best = (gap, a, b)
        gap, a, b = best
        clusters[a] = clusters[a] + clusters.pop(b)
        heights.append(np.sqrt(gap))
        states.append({frozenset(c) for c in clusters})
    return heights, states


def table(spark, points, parts=4):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id bigint, v array<double>").repartition(parts)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(r["id"])
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_same_as_all_pairs(spark, seed):
    points = np.random.default_rng(seed).normal(size=(40, 3))
    df = table(spark, points)
    model = ward.fit_ward(df, "v")
    heights, states = plain(points)
    assert np.allclose([h for _, _, h, _ in model.merges], heights) and model.spread == pytest.approx(0)
    for k in (1, 2, 5, 17, 40):
        found = groups(model.assign(df, "id", "v", k))
        assert {frozenset(g) for g in found.values()} == ({frozenset([i]) for i in range(40)} if k == 40 else states[39 - k])
        assert sorted(found, key=lambda c: -len(found[c]))[0] == 0 or len(found[0]) == max(map(len, found.values()))
    merges = model.merge_table(df).orderBy("step").collect()
    assert merges[-1]["size"] == 40 and all(r["left"] < r["right"] < 40 + r["step"] for r in merges)


@pytest.mark.parametrize("kind", ["scattered", "grid", "twice", "outliers"])
def test_rounds_give_the_whole_tree(spark, kind):
    """More different rows than the driver merges: every one of them is a leaf, and the merges are those of comparing all pairs."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(60, 3))
    if kind == "grid":
        points = np.stack(np.meshgrid(*[np.arange(4.0)] * 3), -1).reshape(-1, 3) * 0.1 + 5
    elif kind == "twice":
        points = np.concatenate([points, points[:20]])
    elif kind == "outliers":
        points[:4] = [[90, 0, 0], [95, 0, 0], [-90, 0, 0], [-97, 0, 0]]
    df = table(spark, points)
    tree = ward.fit_ward(df, "v", by_driver=7)
    n = len(np.unique(points, axis=0))
    merges = tree.merge_table(df).orderBy("step").collect()
    assert len(merges) == n - 1 and [r["step"] for r in merges] == list(range(n - 1)) and merges[-1]["size"] == len(points)
    assert sorted(x for r in merges for x in (r["left"], r["right"])) == list(range(2 * n - 2))
    assert all(r["left"] < r["right"] < n + r["step"] for r in merges)
    total = ((points - points.mean(axis=0)) ** 2).sum()
    rows, variance = tree.variance()
    assert rows == len(points) and variance == pytest.approx(total)
    heights, states = plain(points)
    if kind != "grid":  # with equal distances there are several right trees
        assert np.allclose([r["height"] for r in merges], heights[len(points) - n :])
    for k in (1, 3, 5):
        found = groups(tree.assign(df, "id", "v", k))
        assert sorted(found) == list(range(k)) and sum(map(len, found.values())) == len(points) and len(found[0]) == max(map(len, found.values()))
        if kind != "grid":
            assert {frozenset(g) for g in found.values()} == states[len(points) - 1 - k]


def test_merges_of_all_rows(spark, tmp_path):
    """More different vectors than the driver merges; each takes part in the query's merges."""
    from voxtide.plans.catalog import QUERIES

    points = np.random.default_rng(7).normal(size=(ward.LEAVES + 300, 2))
    spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    merges = QUERIES["ward_merges"].run(spark, str(tmp_path))
    assert merges.count() == len(points) - 1 and merges.agg(F.max("size")).first()[0] == len(points)


def test_bounded_leaves(spark):
    """Far more rows than leaves: three groups stay apart, every row has a cluster, and no variance is lost."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.3, size=(400, 2)) for c in ((0, 0), (8, 0), (0, 9))])
    df = table(spark, points, 20)
    model = ward.fit_ward(df, "v", most=50)
    assert len(model.n) <= 50 and model.n.sum() == 1200
    total = ((points - points.mean(axis=0)) ** 2).sum()
    assert model.spread + sum(h * h / 2 for _, _, h, _ in model.merges) == pytest.approx(total, rel=1e-6)
    found = groups(model.assign(df, "id", "v", 3))
    assert {frozenset(g) for g in found.values()} == {frozenset(range(400 * i, 400 * (i + 1))) for i in range(3)}


def test_odd_tables(spark):
    same = table(spark, np.ones((30, 2)))
    model = ward.fit_ward(same, "v")
    assert len(model.n) == 1 and groups(model.assign(same, "id", "v", 3)) == {0: set(range(30))}
    none = same.limit(0)
    assert ward.fit_ward(none, "v").merges == []
    some = same.withColumn("v", F.when(F.col("id") > 3, F.col("v")))
    assert ward.fit_ward(some, "v").assign(some, "id", "v", 1).count() == 26
    vectors = table(spark, np.arange(12.0).reshape(6, 2)).select("id", features.dense_vector("v").alias("features"))
    assert ward.ward_clusters(vectors, "id", 2).select("cluster").distinct().count() == 2


def test_partitions_without_rows(spark):
    """Files are cut into ranges, and some hold no rows."""
    points = np.random.default_rng(5).normal(size=(12, 2))
    df = table(spark, points, 1).repartition(6, F.lit(1))
    assert 0 in df.rdd.mapPartitions(lambda rows: [len(list(rows))]).collect()
    model = ward.fit_ward(df, "v")
    assert np.allclose([h for _, _, h, _ in model.merges], plain(points)[0])
    assert groups(model.assign(df, "id", "v", 1)) == {0: set(range(12))}


@pytest.mark.parametrize("block_rows", [16_384, 7])
def test_silhouette_meets_few_clusters(spark, block_rows):
    """The values are those over all pairs, and rows ask for few of many clusters."""
    from voxtide.operators import clusters

    rng = np.random.default_rng(4)
    middle = rng.uniform(-50, 50, size=(30, 3))
    own = np.concatenate([np.arange(30), rng.integers(0, 30, 120), [30]])  # the last cluster has one row
    points = np.concatenate([middle, [[0, 0, 0]]])[own] + rng.normal(size=(151, 3)) * np.where(own % 7 == 0, 12.0, 0.5)[:, None]
    rows = [(i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(own, points))]
    df = spark.createDataFrame(rows, "id bigint, cluster int, v array<double>")
    gaps = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    mean = np.array([[gaps[i, own == c].mean() for c in range(31)] for i in range(151)])
    want = {}
    for i, c in enumerate(own):
        n = (own == c).sum()
        a, b = gaps[i, own == c].sum() / max(n - 1, 1), np.delete(mean[i], c).min()
        want[i] = 0.0 if n == 1 else (b - a) / max(a, b)
    got = {r["id"]: r["silhouette"] for r in clusters.silhouette_samples(df, "id", "cluster", "v", block_rows).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    near, _ = clusters.near_clusters(df, "cluster", "v", ["id"])
    assert near.agg(F.avg(F.size("_targets"))).first()[0] < 10


def test_leaves_do_not_collapse():
    """Distances of many columns hardly differ; more rows than leaves must leave at least half of the leaves."""
    points = np.random.default_rng(3).normal(size=(2_000, 48))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    leaves = ward.Leaves(100)
    leaves.add(np.ones(len(points)), points, np.zeros(len(points)))
    assert 50 <= len(leaves.n) <= 100 and leaves.n.sum() == len(points)
    middle = points.mean(axis=0)
    between = (leaves.n * ((leaves.centre - middle) ** 2).sum(axis=1)).sum()
    assert leaves.spread.sum() + between == pytest.approx(((points - middle) ** 2).sum())
