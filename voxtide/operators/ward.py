"""Hierarchical clustering with Ward's linkage, bottom-up.

Every different row is a leaf that counts its rows. Two clusters that are each other's nearest one are
merged whatever else is merged, since a merge never brings clusters nearer to a third one; so all such
pairs merge in one round. A round looks for the nearest cluster only of clusters that are new or whose
nearest one is gone; cuts of these meet cuts of all clusters in tasks. When at most DRIVER clusters are
left, the driver ends the tree with the nearest-neighbour chain. Both give the merges that comparing all
pairs after every merge gives, and every leaf takes part. The work grows with the square of the leaves.

A caller may bound the leaves instead (`most`). Rows are then summarised before they are merged: a leaf
holds the number of its rows, their mean and their summed squared distance from it. Every task keeps at
most so many leaves; when there would be more, neighbouring leaves are merged in pairs and the radius
within which a row joins a leaf grows to theirs, so that no fewer than half stay. The leaves of tasks are
merged in groups, again and again, and the chain runs on the last ones. The variance is never lost: half
the sum of the squared heights and the variance inside leaves add up to the variance of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtide.operators.numbering import number_rows
from voxtide.session import materialize

LEAVES = 2_000  # where a caller bounds them
DRIVER = 8_000  # clusters the driver merges
CUT = 65_536  # clusters of a side that meet in one task
CELLS = 1 << 22  # distances held at once
PAIRS = 65_536  # close pairs measured at once
ROUND = 40  # a cluster's number: the round that made it, and its first leaf in the lower bits
FAN_IN = 16  # tables of leaves merged in one task
STEP = 256  # rows compared with all leaves at once
LEAF_SCHEMA = "part int, n double, centre array<double>, spread double"


class Leaves:
    """At most `most` leaves; adding goes on for as long as rows come."""

    def __init__(self, most: int = LEAVES):
        self.most, self.radius = most, 0.0
        self.n, self.centre, self.spread = np.zeros(0), np.zeros((0, 0)), np.zeros(0)

    def add(self, n: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> None:
        for at in range(0, len(n), STEP):
            self._add(n[at : at + STEP], centre[at : at + STEP], spread[at : at + STEP])
            while len(self.n) > self.most:
                self._coarsen()

    def _join(self, n: np.ndarray, centre: np.ndarray, spread: np.ndarray, leaf: np.ndarray) -> None:
        """Let rows (or leaves) join the leaves named."""
        size = len(self.n)
        total = self.n + np.bincount(leaf, n, size)
        moved = np.zeros_like(self.centre)
        np.add.at(moved, leaf, n[:, None] * (centre - self.centre[leaf]))
        new = self.centre + moved / total[:, None]
        own = self.n * ((new - self.centre) ** 2).sum(axis=1)
        theirs = np.bincount(leaf, n * ((centre - new[leaf]) ** 2).sum(axis=1) + spread, size)
        self.n, self.centre, self.spread = total, new, self.spread + own + theirs

    def _add(self, n: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> None:
        if len(n) and not len(self.n):
            self.centre = self.centre.reshape(0, centre.shape[1])
        if len(self.n) and len(n):
            gaps = _gaps(centre, self.centre)
            nearest = gaps.argmin(axis=1)
            near = self._within(centre, nearest, gaps[np.arange(len(n)), nearest])
            if near.any():
                self._join(n[near], centre[near], spread[near], nearest[near])
            n, centre, spread = n[~near], centre[~near], spread[~near]
        if self.radius == 0 and len(n):  # equal rows are one leaf
            centre, same = np.unique(centre, axis=0, return_inverse=True)
            same = same.ravel()
            n, spread = np.bincount(same, n), np.bincount(same, spread)
        self.n, self.centre = np.concatenate([self.n, n]), np.concatenate([self.centre, centre])
        self.spread = np.concatenate([self.spread, spread])

    def _within(self, centre: np.ndarray, leaf: np.ndarray, gap: np.ndarray) -> np.ndarray:
        if self.radius == 0:
            return (centre == self.centre[leaf]).all(axis=1)
        return gap <= self.radius**2

    def _coarsen(self) -> None:
        """Merge neighbouring leaves in pairs, nearest first, down to three quarters; rows as near join from now on.

        Distances of many columns hardly differ, so that merging all leaves within one radius could leave a
        few; pairs leave at least half of them.
        """
        gaps = _gaps(self.centre, self.centre)
        np.fill_diagonal(gaps, np.inf)
        nearest = gaps.argmin(axis=1)
        gap = gaps[np.arange(len(nearest)), nearest]
        spare = max(len(nearest) - 3 * self.most // 4, 1)
        free, into, gone = np.ones(len(nearest), bool), [], []
        for i in np.argsort(gap, kind="stable"):
            j = nearest[i]
            if i != j and free[i] and free[j]:
                free[i] = free[j] = False
                into.append(min(i, j))
                gone.append(max(i, j))
                self.radius = max(self.radius, float(np.sqrt(gap[i])), 1e-12)
                if len(gone) == spare:
                    break
        self._join(self.n[gone], self.centre[gone], self.spread[gone], np.asarray(into))
        left = np.ones(len(nearest), bool)
        left[gone] = False
        self.n, self.centre, self.spread = self.n[left], self.centre[left], self.spread[left]


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def summarise(points: DataFrame, vector: str, most: int = LEAVES) -> pd.DataFrame:
    """At most `most` leaves (n, centre, spread) of all rows."""

    def frame(leaves: Leaves, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": np.full(len(leaves.n), part, "int32"), "n": leaves.n, "centre": list(leaves.centre), "spread": leaves.spread})

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves, part = Leaves(most), 0
        for batch in batches:
            if len(batch):
                part = int(batch["part"].iloc[0])
                leaves.add(np.ones(len(batch)), np.vstack(batch["v"].to_numpy()), np.zeros(len(batch)))
        if len(leaves.n):  # an empty table would have no lists to tell its types by
            yield frame(leaves, part)

    def of_leaves(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        leaves = Leaves(most)
        table = table.sort_values("n", ascending=False, kind="stable")
        leaves.add(table["n"].to_numpy(), np.vstack(table["centre"].to_numpy()), table["spread"].to_numpy())
        return frame(leaves, int(key[0]))

    rows = points.select(F.spark_partition_id().alias("part"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    parts = materialize(rows.mapInPandas(of_rows, LEAF_SCHEMA), "leaves")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).applyInPandas(of_leaves, LEAF_SCHEMA)
        parts = materialize(parts, "leaves")
    return parts.select("n", "centre", "spread").toPandas()


def chain(n: np.ndarray, centre: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Ward's merges (left, right, height, size) in order of height; merge i makes cluster len(n) + i."""
    leaves = len(n)
    size, middle = n.astype(float).copy(), centre.astype(float).copy()
    active = np.ones(leaves, bool)
    square = (middle * middle).sum(axis=1)
    rounding = 8 * (middle.shape[1] + 8) * np.finfo(float).eps
    found, path = [], []  # merges as pairs of leaves that stand for their clusters

    def gaps(at: int, some: np.ndarray) -> np.ndarray:
        return 2 * size[some] * size[at] / (size[some] + size[at]) * ((middle[some] - middle[at]) ** 2).sum(axis=1)

    while active.sum() > 1:
        if not path:
            path.append(int(np.flatnonzero(active)[0]))
        at = path[-1]
        # products tell which ones can be nearest within their rounding; these are measured by differences
        gap = 2 * size * size[at] / (size + size[at]) * (square + square[at] - 2 * (middle @ middle[at]))
        gap[~active] = np.inf
        gap[at] = np.inf
        near = np.flatnonzero(gap <= gap.min() + rounding * size[at] * (square[at] + square.max()))
        if not len(near):  # numbers that are not finite
            near = np.flatnonzero(active & (np.arange(leaves) != at))
        true = gaps(at, near)
        best, least = int(near[true.argmin()]), true.min()
        if len(path) > 1 and gaps(at, np.asarray(path[-2:-1]))[0] <= least:
            best = path[-2]
        if len(path) > 1 and best == path[-2]:
            path = path[:-2]
            a, b = min(at, best), max(at, best)
            found.append((float(np.sqrt(gaps(a, np.asarray([b]))[0])), a, b))
            middle[a] = (size[a] * middle[a] + size[b] * middle[b]) / (size[a] + size[b])
            square[a] = (middle[a] * middle[a]).sum()
            size[a] += size[b]
            active[b] = False
        else:
            path.append(best)
    # a merge never stands below the merges it is made of, so sorting by height keeps their order
    order = sorted(range(len(found)), key=lambda i: (found[i][0], i))
    name, total = list(range(leaves)), n.astype(float).tolist()
    root = list(range(leaves))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for step, i in enumerate(order):
        height, a, b = found[i]
        a, b = top(a), top(b)
        left, right = sorted((name[a], name[b]))
        total[a] += total[b]
        root[b] = a
        name[a] = leaves + step
        out.append((left, right, height, total[a]))
    return out


def nearest(x: np.ndarray, n: np.ndarray, ids: np.ndarray, y: np.ndarray, m: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row of x, Ward's distance, lower and higher number) of the nearest other cluster; of equal ones the pair of lowest numbers.

    Products tell which ones can be nearest within their rounding; these are measured by differences,
    which give the same distance from either side.
    """
    out = []
    square_x, square_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
    error = (x.shape[1] + 8) * np.finfo(float).eps * (square_x + square_y.max()) * 4 * n
    order = np.argsort(others)
    place = order[np.minimum(np.searchsorted(others, ids, sorter=order), len(others) - 1)]
    step = max(1, min(STEP, CELLS // len(y)))
    for at in range(0, len(x), step):
        own = slice(at, at + step)
        gap = x[own] @ y.T
        gap *= -2
        gap += square_x[own, None]
        gap += square_y
        gap *= 2 * n[own, None] * m / (n[own, None] + m)
        self_ = np.flatnonzero(others[place[own]] == ids[own])
        gap[self_, place[own][self_]] = np.inf
        row, col = np.nonzero((gap <= (gap.min(axis=1) + error[own])[:, None]) & np.isfinite(gap))
        row += at
        for some in range(0, len(row), PAIRS):
            i, j = row[some : some + PAIRS], col[some : some + PAIRS]
            true = 2 * n[i] * m[j] / (n[i] + m[j]) * ((x[i] - y[j]) ** 2).sum(axis=1)
            low, high = np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j])
            best = np.lexsort((high, low, true, i))
            best = best[np.unique(i[best], return_index=True)[1]]
            out.append((i[best], true[best], low[best], high[best]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, int))


LINK = "id bigint, link struct<gap:double,low:bigint,high:bigint>"


def _links(asked: DataFrame, clusters: DataFrame, n_asked: int, n_clusters: int) -> DataFrame:
    """(id, link) of the nearest clusters found in each cut of `clusters`."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    left = max(math.ceil(n_asked / CUT), round(math.sqrt(2 * cores * n_asked / n_clusters)), 1)
    right = max(math.ceil(n_clusters / CUT), math.ceil(2 * cores / left))
    cut, own = F.xxhash64("id"), [F.col(c).alias(c) for c in ("id", "n", "c")]  # columns of either side, though of one table
    q = asked.select(*own, F.pmod(cut, F.lit(left)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(right - 1))).alias("j"))
    p = clusters.select(*own, F.pmod(cut, F.lit(right)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("i"))

    def sides(table: pa.Table) -> tuple[np.ndarray, ...]:
        vectors = table["c"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        return vectors, table["n"].to_numpy(), table["id"].to_numpy()

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        found = (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        if q.num_rows and p.num_rows:
            found = nearest(*sides(q), *sides(p))
        ids = q["id"].to_numpy()[found[0]] if q.num_rows else found[0]
        link = pa.StructArray.from_arrays([pa.array(found[1]), pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64())], ["gap", "low", "high"])
        return pa.table({"id": pa.array(ids, pa.int64()), "link": link})

    return q.groupBy("i", "j").cogroup(p.groupBy("i", "j")).applyInArrow(meet, LINK)


def merge_rounds(leaves: DataFrame, n_leaves: int, most: int = DRIVER) -> tuple[list[DataFrame], DataFrame]:
    """The merges of every round (id, low, high, n, h), and the clusters (id, n, c, h) left, at most `most`."""
    state, count, links, merges = leaves.select("id", "n", "c", F.lit(0.0).alias("h")), n_leaves, None, []
    while count > most:
        asked = state if links is None else state.join(links, "id", "left_anti")
        new = materialize(_links(asked, state, asked.count(), count), "nearest")
        known = new if links is None else new.unionByName(links)
        back = known.select((F.col("link.low") + F.col("link.high") - F.col("id")).alias("id"), "link")
        links = materialize(known.unionByName(back).groupBy("id").agg(F.min("link").alias("link")), "links")
        # the pair of the least distance is always one whose sides name each other
        pairs = links.groupBy("link").count().where("count = 2").select("link.*")
        first = F.lit(2**ROUND - 1)
        name = F.lit((len(merges) + 1) << ROUND) + F.least(F.col("low").bitwiseAND(first), F.col("high").bitwiseAND(first))
        a, b = (state.select(F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "c", "h"))) for end in ("low", "high"))
        n = F.col("n_low") + F.col("n_high")
        middle = F.zip_with("c_low", "c_high", lambda x, y: (F.col("n_low") * x + F.col("n_high") * y) / n)
        joined = pairs.join(a, "low").join(b, "high").select(
            name.alias("id"), "low", "high", n.alias("n"), middle.alias("c"),
            F.greatest(F.sqrt("gap"), "h_low", "h_high").alias("h"),  # rounding may put a merge below those it is made of
        )
        joined = materialize(joined, "merges")
        merged = joined.count()
        if not merged:
            raise ValueError("too many vectors hold numbers that are not finite")
        gone = joined.select(F.explode(F.array("low", "high")).alias("gone"))
        state = materialize(state.join(gone, F.col("id") == F.col("gone"), "left_anti").unionByName(joined.select("id", "n", "c", "h")), "clusters")
        for end in ("low", "high"):
            links = links.join(gone, F.col(f"link.{end}") == F.col("gone"), "left_anti")
        merges.append(joined.drop("c"))
        count -= merged
    return merges, state


@dataclass(frozen=True)
class WardTree:
    """Leaves (id, n, c) and numbered merges (step, id, low, high, n, h), lowest first, as tables."""

    leaves: DataFrame
    n_leaves: int
    merges: DataFrame

    @staticmethod
    def grow(leaves: DataFrame, n_leaves: int, most: int = DRIVER) -> WardTree:
        merges, rest = merge_rounds(leaves, n_leaves, most)
        left = rest.toPandas().sort_values("id", ignore_index=True)
        n, centre = left["n"].to_numpy(), np.vstack(left["c"].to_numpy())
        name, height = left["id"].tolist(), left["h"].tolist()
        rows = []
        for step, (a, b, h, size) in enumerate(chain(n, centre)):
            name.append((len(merges) + 1 << ROUND) + step)
            height.append(max(h, height[a], height[b]))
            rows.append((name[-1], *sorted((name[a], name[b])), float(size), height[-1]))
        last = leaves.sparkSession.createDataFrame(rows, "id bigint, low bigint, high bigint, n double, h double")
        every = reduce(DataFrame.unionByName, [*merges, last])
        return WardTree(leaves, n_leaves, materialize(number_rows(every, ["h", "id"], 0, "step"), "tree"))

    def variance(self) -> tuple[int, float]:
        """Rows, and their summed squared distance from their mean as the merges hold it."""
        total = self.merges.agg(F.max("n"), F.sum(F.col("h") * F.col("h") / 2)).first()
        return int(total[0]), total[1]

    def merge_table(self, points: DataFrame) -> DataFrame:
        """(step, left, right, height, size): leaves are numbered from 0, merges go on from there."""
        made = self.merges.select(F.col("id").alias("made"), (F.col("step") + self.n_leaves).alias("number"))
        ends = self.merges
        for end in ("low", "high"):
            ends = ends.join(made.withColumnsRenamed({"made": end, "number": f"number_{end}"}), end, "left")
        a, b = (F.coalesce(f"number_{end}", end) for end in ("low", "high"))  # a leaf is named by its number
        return ends.select(
            F.col("step").cast("int").alias("step"), F.least(a, b).cast("int").alias("left"), F.greatest(a, b).cast("int").alias("right"),
            F.col("h").alias("height"), F.col("n").cast("bigint").alias("size"),
        )

    def assign(self, points: DataFrame, key: str, vector: str, k: int) -> DataFrame:
        """(key, cluster) of the rows fitted on when k clusters are left. Rows without a vector are left out."""
        kept = self.merges.where(F.col("step") < self.n_leaves - k)
        up = materialize(kept.select(F.explode(F.array("low", "high")).alias("node"), F.col("id").alias("top")), "parents")
        while True:  # a way up is twice as long after each round
            on = up.select(F.col("node").alias("top"), F.col("top").alias("higher"))
            up = materialize(up.join(on, "top", "left").select("node", F.coalesce("higher", "top").alias("top"), F.col("higher").isNotNull().alias("went")), "parents")
            if not up.where("went").limit(1).count():
                break
        placed = self.leaves.join(up.select(F.col("node").alias("id"), "top"), "id", "left").select("id", "n", "c", F.coalesce("top", "id").alias("top"))
        sizes = placed.groupBy("top").agg(F.sum("n").alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first").collect()  # k rows
        number = points.sparkSession.createDataFrame([(r["top"], i) for i, r in enumerate(sizes)], "top bigint, cluster int")
        labels = placed.join(F.broadcast(number), "top").select(F.col("c").alias("v"), "cluster")
        rows = points.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        return rows.join(labels, "v").select(key, "cluster")


@dataclass(frozen=True)
class WardModel:
    """Leaves, their merges in order of height, and the variance inside the leaves."""

    n: np.ndarray
    centre: np.ndarray
    merges: list[tuple[int, int, float, float]]
    spread: float

    def variance(self) -> tuple[int, float]:
        """Rows, and their summed squared distance from their mean as leaves and merges hold it."""
        return int(self.n.sum()), self.spread + sum(h * h / 2 for _, _, h, _ in self.merges)

    def cut(self, k: int) -> np.ndarray:
        """Cluster of each leaf when k are left; the largest cluster is 0, ties by the first leaf."""
        leaves = len(self.n)
        root = list(range(2 * leaves))
        for step, (a, b, _, _) in enumerate(self.merges[: max(leaves - k, 0)]):
            root[a] = root[b] = leaves + step
        top = []
        for i in range(leaves):
            while root[i] != i:
                i = root[i]
            top.append(i)
        rows: dict[int, float] = {}
        for i, n in zip(top, self.n, strict=True):
            rows[i] = rows.get(i, 0.0) + n
        order = {t: c for c, t in enumerate(sorted(rows, key=lambda t: (-rows[t], top.index(t))))}
        return np.asarray([order[t] for t in top], np.int32)

    def assign(self, points: DataFrame, key: str, vector: str, k: int) -> DataFrame:
        """(key, cluster) of all rows: the cluster of the nearest leaf. Rows without a vector are left out."""
        label = self.cut(k)
        sent = points.sparkSession.sparkContext.broadcast((self.centre, label))  # at most LEAVES leaves

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centre, label = sent.value
            for batch in batches:
                some = [
                    label[_gaps(np.vstack(batch["v"].iloc[at : at + STEP].to_numpy()), centre).argmin(axis=1)] for at in range(0, len(batch), STEP)
                ]
                yield pd.DataFrame({key: batch[key], "cluster": np.concatenate(some) if some else np.zeros(0, np.int32)})

        rows = points.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        return rows.mapInPandas(place, T.StructType([rows.schema[key], T.StructField("cluster", T.IntegerType())]))

    def merge_table(self, points: DataFrame) -> DataFrame:
        """(step, left, right, height, size): leaves are numbered from 0, merges go on from there."""
        rows = [(i, a, b, h, int(s)) for i, (a, b, h, s) in enumerate(self.merges)]
        return points.sparkSession.createDataFrame(rows, "step int, left int, right int, height double, size bigint")


def fit_ward(points: DataFrame, vector: str, most: int | None = None, by_driver: int = DRIVER) -> WardModel | WardTree:
    """Fit on an array column; all rows need vectors of one length.

    Equal rows are one leaf. The tree is that of all leaves, unless `most` bounds them; up to `by_driver`
    leaves are merged by the driver alone.
    """
    if most is not None:
        leaves = summarise(points, vector, most)
        if not len(leaves):
            return WardModel(np.zeros(0), np.zeros((0, 0)), [], 0.0)
        centre, n = np.vstack(leaves["centre"].to_numpy()), leaves["n"].to_numpy()
        order = np.lexsort(centre.T[::-1])  # whatever order the tasks end in
        return WardModel(n[order], centre[order], chain(n[order], centre[order]), float(leaves["spread"].sum()))
    rows = points.select(F.col(vector).cast("array<double>").alias("c")).where("c is not null")
    rows = materialize(rows.groupBy("c").agg(F.count("*").cast("double").alias("n")), "leaves")
    count = rows.count()
    if count > by_driver:
        return WardTree.grow(materialize(number_rows(rows, ["c"], 0), "numbered leaves"), count, by_driver)
    if not count:
        return WardModel(np.zeros(0), np.zeros((0, 0)), [], 0.0)
    leaves = rows.toPandas()
    centre, n = np.vstack(leaves["c"].to_numpy()), leaves["n"].to_numpy()
    order = np.lexsort(centre.T[::-1])
    return WardModel(n[order], centre[order], chain(n[order], centre[order]), 0.0)


def ward_clusters(df: DataFrame, key: str, k: int = 5, features: str = "features", most: int | None = None) -> DataFrame:
    """(key, cluster) of rows with a vector column."""
    points = df.select(key, vector_to_array(features).alias("_vector"))
    return fit_ward(points, "_vector", most).assign(points, key, "_vector", k)
