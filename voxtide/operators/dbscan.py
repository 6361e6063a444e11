"""Exact density clustering (DBSCAN, Euclidean) in any dimension.

Points are cut into blocks of bounded size: by nearest pivot, and by hash where many
points share a pivot. Two blocks meet in a task only if the balls around them come
within eps. A task compares its two blocks as matrices and returns sums and component
labels per point, never the neighbouring pairs, so that a dense clump costs compute
but no quadratic output.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions.hashing import hash_int
from voxtide.operators.components import connected_components
from voxtide.operators.numbering import number_rows
from voxtide.session import materialize

SLACK = 1e-9  # keeps rounding from ruling out a pair of blocks that just touch
NONE = np.iinfo(np.int64).max
LARGEST = 65_536  # points of a region
REGIONS = 16  # unless they would hold more points than that


def _blocks(points: DataFrame, eps: float, block_rows: int, max_pivots: int) -> tuple[DataFrame, int, Callable]:
    """Points (id, v, block, region), the number of regions, and which pairs of blocks may hold neighbours.

    A region is a range of blocks. Points travel to pairs of regions, of which there are few whatever the number of
    blocks, so that a point is copied once per region; blocks are compared within the tasks.
    """
    spark = points.sparkSession
    n = points.count()
    wanted = min(max(1, math.ceil(n / block_rows)), max_pivots)
    picked = points.orderBy(hash_int(F.col("id"), "pivot"), "id").limit(wanted).select("v").collect()
    pivots = np.array([row["v"] for row in picked], dtype=float).reshape(len(picked), -1 if picked else 0)
    sent = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = sent.value
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["v"].to_numpy())
            gaps = np.stack([np.linalg.norm(x - c, axis=1) for c in centres], axis=1)
            own = gaps.argmin(axis=1)
            yield batch.assign(cell=own.astype("int32"), gap=gaps[np.arange(len(x)), own])

    located = materialize(points.mapInPandas(nearest, "id bigint, v array<double>, cell int, gap double"), "points")
    cells = located.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()

    # A cell with more points than a block may hold is cut by hash into slices.
    first, slices = {}, {}
    blocks = 0
    for row in sorted(cells, key=lambda r: r["cell"]):
        first[row["cell"]], slices[row["cell"]] = blocks, math.ceil(row["n"] / block_rows)
        blocks += slices[row["cell"]]
    cell_of = [c for c in first for _ in range(slices[c])]
    sizes = [math.ceil(row["n"] / slices[row["cell"]]) for row in sorted(cells, key=lambda r: r["cell"]) for _ in range(slices[row["cell"]])]
    regions = max(1, min(blocks, max(REGIONS, math.ceil(n / LARGEST))))
    before = np.cumsum([0, *sizes])
    region_of = [int(before[b] * regions // max(before[-1], 1)) for b in range(blocks)]
    rows = [(c, first[c], slices[c]) for c in first]
    plan = spark.createDataFrame(rows or [(0, 0, 1)], "cell int, first int, slices int")
    owner = spark.createDataFrame(list(enumerate(region_of)) or [(0, 0)], "block int, region int")
    cut = located.join(F.broadcast(plan), "cell").select(  # one row per pivot
        "id", "v", (F.col("first") + F.pmod(hash_int(F.col("id"), "slice"), F.col("slices"))).cast("int").alias("block")
    ).join(F.broadcast(owner), "block")  # one row per block
    radius = {row["cell"]: row["radius"] for row in cells}
    shared = spark.sparkContext.broadcast((np.array(cell_of, int), np.array([radius.get(c, 0.0) for c in range(len(pivots))])))

    def close(block: int, others: np.ndarray) -> np.ndarray:
        """Which of the other blocks may hold neighbours of this one's points."""
        cells_, radii = shared.value
        own, other = cells_[block], cells_[others]
        gap = np.linalg.norm(sent.value[other] - sent.value[own], axis=1)
        return gap <= radii[own] + radii[other] + eps + SLACK

    return cut, regions, close


def _meet(points: DataFrame, regions: int) -> DataFrame:
    """Every point once per pair of regions (lo, hi) that its own one takes part in."""
    other = F.explode(F.sequence(F.lit(0), F.lit(regions - 1))).alias("other")
    return points.select("*", other).withColumns({"lo": F.least("region", "other"), "hi": F.greatest("region", "other")}).drop("other")


def _pairs(group: pd.DataFrame, close: Callable) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Pairs of blocks of a pair of regions that may hold neighbours, with the rows of each; every pair in one task only."""
    block, region = group["block"].to_numpy(), group["region"].to_numpy()
    low, high = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
    order = np.argsort(block, kind="stable")
    names, start = np.unique(block[order], return_index=True)
    places = np.split(order, start[1:])
    home = region[[p[0] for p in places]]
    for a in np.flatnonzero(home == low):
        others = np.flatnonzero((home == high) & (names >= names[a]))
        for b in others[close(names[a], names[others])]:
            yield names[a], places[a], names[b], places[b]


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    near = square <= eps * eps
    # The expanded square loses digits; settle the doubtful pairs directly.
    scale = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] + eps * eps
    a, b = np.nonzero(np.abs(square - eps * eps) <= 1e-9 * scale)
    if len(a):
        near[a, b] = ((x[a] - y[b]) ** 2).sum(1) <= eps * eps
    return near


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.vstack(rows["v"].to_numpy())


def _lowest(near: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smallest label among the neighbours of each row."""
    if not near.size:
        return np.full(near.shape[0], NONE)
    return np.where(near, labels[None, :], NONE).min(axis=1)


def dbscan(df: DataFrame, key: str, vector: str, eps: float = 0.5, min_samples: int = 5, block_rows: int = 2048,
           max_pivots: int = 1024) -> DataFrame:
    """(key, core, component, cluster): noise has cluster −1, clusters are numbered by their smallest core key.

    `key` must be an integer. A point within eps of core points of several clusters
    goes to the cluster with the smallest number.
    """
    points = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    cut, regions, close = _blocks(points, eps, block_rows, max_pivots)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        v, n = _matrix(group), np.zeros(len(group), np.int64)
        for low, a, high, b in _pairs(group, close):
            near = _near(v[a], v[b], eps)
            n[a] += near.sum(axis=1)
            if low != high:
                n[b] += near.sum(axis=0)
        return pd.DataFrame({"id": group["id"], "n": n})

    neighbours = _meet(cut, regions).groupBy("lo", "hi").applyInPandas(count, "id bigint, n bigint")
    flags = neighbours.groupBy("id").agg((F.sum("n") >= min_samples).alias("core"))
    flagged = materialize(cut.join(flags, "id"), "flagged")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        """For each point the smallest core key it reaches within this pair of regions."""
        group = group.sort_values("id", ignore_index=True)
        v, ids, core = _matrix(group), group["id"].to_numpy(), group["core"].to_numpy(dtype=bool)
        root = np.arange(len(group))  # of a core point: a row before it, or itself

        def top(rows: np.ndarray) -> np.ndarray:
            while True:
                up = root[rows]
                if np.array_equal(up, rows):
                    return rows
                rows = up

        def join(old: np.ndarray, new: np.ndarray) -> None:
            for x, y in np.unique(np.stack([old, new], axis=1)[old != new], axis=0):
                x, y = top(np.array([x, y]))
                root[max(x, y)] = min(x, y)

        outer, inner_ = [], []  # border points and the core points they touch: fewer than min_samples each
        for low, a, high, b in _pairs(group, close):
            near = _near(v[a], v[b], eps)
            core_a, core_b = a[core[a]], b[core[b]]
            inner = near[np.ix_(core[a], core[b])]
            old_a, old_b = root_a, root_b = top(core_a), top(core_b)
            root[core_a], root[core_b] = old_a, old_b  # shorter ways next time
            while inner.any():
                new_a = np.minimum(root_a, _lowest(inner, root_b))
                new_b = np.minimum(root_b, _lowest(inner.T, new_a))
                if low == high:
                    new_a = new_b = np.minimum(new_a, new_b)
                if np.array_equal(new_a, root_a) and np.array_equal(new_b, root_b):
                    break
                root_a, root_b = new_a, new_b
            join(old_a, root_a)
            join(old_b, root_b)
            i, j = np.nonzero(near & ~core[a][:, None] & core[b][None, :])
            outer.append(a[i])
            inner_.append(b[j])
            if low != high:
                i, j = np.nonzero(near & core[a][:, None] & ~core[b][None, :])
                outer.append(b[j])
                inner_.append(a[i])
        cores = np.flatnonzero(core)
        out = pd.DataFrame({"id": ids[cores], "root": ids[top(cores)], "core": True})
        if not outer:
            return out
        border, touched = np.concatenate(outer), top(np.concatenate(inner_))
        borders = pd.DataFrame({"id": ids[border], "root": ids[touched], "core": False})
        return pd.concat([out, borders.drop_duplicates()])

    links = _meet(flagged, regions).groupBy("lo", "hi").applyInPandas(link, "id bigint, root bigint, core boolean")
    links = materialize(links, "links")
    linked = connected_components(links.where("core"), "id", "root")
    cores = flagged.where("core").select(F.col("id").alias("node")).join(linked, "node", "left")
    # Written out, so that border points of a large cluster, whose root is hot, can be split.
    cores = materialize(cores.select("node", F.coalesce("component", "node").alias("component")), "cores")
    borders = (
        links.where("not core").join(cores, F.col("root") == F.col("node"))
        .groupBy("id").agg(F.min("component").alias("component"))
    )
    members = cores.select(F.col("node").alias("id"), "component").unionByName(borders)
    members = materialize(members, "members")
    names = number_rows(members.select("component").distinct(), ["component"], start=0, name="cluster")
    return (
        flagged.select("id", "core").join(members, "id", "left").join(names, "component", "left")
        .select(F.col("id").alias(key), "core", "component",
                F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
    )
