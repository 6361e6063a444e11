"""Exact top-k search by inner product over vectors grouped by length.

Vectors are grouped into buckets of similar length. A first guess of each query's k-th best
score comes from the longest vectors; divided by the query's length and the bucket's largest
length it is the least cosine a vector of the bucket needs. A query leaves out buckets that
would need a cosine over one. In the others it prunes either by coordinates (a vector that is
close in angle is close in the query's largest coordinates) or by length (a prefix of the bucket
sorted by length), and the products of what is left are computed exactly.

Queries and buckets meet in blocks of bounded size; only the k best of a block leave it. A block
holds queries that reach the same buckets, and a bucket is sent to the blocks that reach it only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.llm.common import small_batches
from voxtide.session import materialize

BINS_PER_OCTAVE = 8  # buckets hold lengths within a factor of 2 ** (1/8)
NO_BOUND = -(2.0**1000)
ANGLE = 0.5  # from this local cosine on, coordinates prune better than lengths
FOCUS = 3  # coordinates looked at
SLACK = 1e-9  # for rounding; only ever lets more candidates through


def _matrix(vectors: pa.ChunkedArray | pa.Array, scale: float) -> np.ndarray:
    """Rows of floor(scale * x); rows shorter than the longest are filled with zeros."""
    rows = [np.asarray(v, dtype=np.float64) for v in vectors.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, row in enumerate(rows):
        out[i, : len(row)] = np.floor(row * scale)
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in (a, b))


def _lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(1))


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products: as doubles while every sum stays below 2^53, else as long integers.

    Scores that no 64-bit integer holds become the nearest one.
    """
    top = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(q.shape[1], 1)
    if top < 2.0**53:
        return (q @ p.T).astype(np.int64)
    big = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in p]
    low, high = -(2**63), 2**63 - 1
    return np.array(
        [[min(high, max(low, sum(x * y for x, y in zip(a, b, strict=True)))) for b in big[1]] for a in big[0]], np.int64
    ).reshape(len(q), len(p))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Bucket:
    """Vectors of a bucket in falling order of length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = _lengths(vectors)
        order = np.lexsort((ids, -lengths))
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        self.longest = float(self.lengths[0]) if len(order) else 0.0
        self.unit = self.vectors / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def by_coordinates(self, unit_query: np.ndarray, cosine: float) -> np.ndarray:
        """Vectors whose largest query coordinates allow the cosine."""
        focus = np.argsort(-np.abs(unit_query), kind="stable")[:FOCUS]
        regions = []
        for f in focus:
            middle = unit_query[f] * cosine
            reach = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - unit_query[f] ** 2)))
            order, values = self.column(int(f))
            # A vector closer than the needed cosine may lie beyond one end of the region only when the query does
            low = -np.inf if unit_query[f] < 0 and -unit_query[f] >= cosine else middle - reach - SLACK
            high = np.inf if unit_query[f] >= cosine else middle + reach + SLACK
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            regions.append((b - a, order[a:b], int(f), low, high))
        regions.sort(key=lambda r: r[0])
        found = regions[0][1]
        for _, _, f, low, high in regions[1:]:
            x = self.unit[found, f]
            found = found[(x >= low) & (x <= high)]
        return found

    def by_length(self, least: float) -> int:
        """How many of the vectors are at least that long."""
        return int(np.searchsorted(-self.lengths, -least * (1 - SLACK) + SLACK, "right"))


def search_bucket(
    q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, bucket: Bucket, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its place, ids, scores) of the k best in the bucket that reach its bound."""
    lengths = _lengths(queries)
    limit = lengths * bucket.longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(np.isfinite(limit) & (limit > 0), bounds / np.where(limit > 0, limit, 1.0), -1.0)
    out_of_reach = (local > 1 + SLACK) | ((limit == 0) & (bounds > 0))
    by_angle = ~out_of_reach & (local >= ANGLE)

    def chosen(i: int, scores: np.ndarray, ids: np.ndarray):
        keep = (scores >= bounds[i]) & (ids != q_ids[i])
        scores, ids = scores[keep], ids[keep]
        at = _best(scores, ids, k)
        return i, ids[at], scores[at]

    for i in np.flatnonzero(by_angle):
        at = bucket.by_coordinates(queries[i] / lengths[i], min(1.0, float(local[i])))
        yield chosen(i, _products(queries[i : i + 1], bucket.vectors[at])[0], bucket.ids[at])
    rest = np.flatnonzero(~out_of_reach & ~by_angle)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(lengths > 0, bounds / np.where(lengths > 0, lengths, 1.0), 0.0)
    for some in (rest[i : i + 128] for i in range(0, len(rest), 128)):
        prefix = [bucket.by_length(float(least[i])) if least[i] > 0 else len(bucket.ids) for i in some]
        scores = _products(queries[some], bucket.vectors[: max(prefix)])
        for row, i, n in zip(scores, some, prefix, strict=True):
            yield chosen(i, row[:n], bucket.ids[:n])


def exact_top_k(
    vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20,
    scale: float = 64.0, query_rows: int = 1024, bucket_rows: int = 4096, seed_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * x) for each query.

    `is_query` picks the queries among the rows; every other row is a candidate. Ties go to the
    smaller id. Rows whose id is null or whose vector is null or holds a null, NaN or infinite
    component take no part. Ids that occur more than once count once, with the smallest vector.
    Vectors of different length meet as if filled with zeros; empty vectors score 0. A query with
    fewer than k candidates gets all. An empty table gives an empty result.

    What the driver holds: two rows per length bin (lengths of doubles fall into fewer than 17,000
    bins) and the `seed_rows` longest vectors, which give the first bounds. Other columns of the
    table are not read, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    clean = x.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    one = clean.groupBy("id").agg(F.min("v").alias("v"), F.coalesce(F.bool_or("q"), F.lit(False)).alias("q"))

    def whole(c: Column) -> Column:
        big = F.least(F.greatest(c * scale, F.lit(-1e140)), F.lit(1e140))  # squares stay finite
        return F.when(F.abs(big) < 2.0**52, F.floor(big).cast("double")).otherwise(big)

    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + whole(c) * whole(c))
    bin_ = F.when(square > 0, F.floor(F.log2(square) / 2 * BINS_PER_OCTAVE)).otherwise(-1).cast("int")
    binned = one.withColumn("n2", square).withColumn("bin", bin_)

    sizes = binned.groupBy("bin").agg(F.count("*").alias("n")).collect()
    parts = {r["bin"]: -(-r["n"] // bucket_rows) for r in sizes}
    top = binned.select("id", "v", "n2").orderBy(F.desc("n2"), "id").limit(seed_rows).toArrow()
    seeds = spark.sparkContext.broadcast((np.asarray(top["id"].to_numpy(), np.int64), _matrix(top["v"], scale)))

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_ids, s = seeds.value
        for batch in batches:
            ids, q = np.asarray(batch["id"].to_numpy(zero_copy_only=False), np.int64), _matrix(batch["v"], scale)
            a, b = _same_width(q, s)
            bounds = np.full(len(ids), NO_BOUND)
            for i in range(len(ids)):
                scores = _products(a[i : i + 1], b)[0][s_ids != ids[i]]
                if len(scores) >= k:
                    bounds[i] = float(np.partition(scores, len(scores) - k)[len(scores) - k])
            # a double may round a large score up; one step down keeps it a lower bound
            bounds = np.where(np.abs(bounds) >= 2.0**53, np.nextafter(bounds, -np.inf), bounds)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], batch["n2"], pa.array(bounds)], ["id", "v", "n2", "bound"])

    asked = binned.where("q").select("id", "v", "n2").mapInArrow(first_bounds, "id bigint, v array<double>, n2 double, bound double")
    bins = F.array(*[
        F.struct(F.lit(b).alias("bin"), F.lit(n).alias("parts"), F.lit(1e300 if b >= 480 else 2.0 ** ((b + 1) / BINS_PER_OCTAVE)).alias("most"))
        for b, n in sorted(parts.items())
    ]) if parts else F.array().cast("array<struct<bin:int,parts:int,most:double>>")
    in_reach = F.filter(bins, lambda b: (F.sqrt("n2") * b["most"] * (1 + SLACK) >= F.col("bound")) | (F.col("bound") <= 0))
    # buckets in reach are all from some length on; queries with the same shortest one share blocks
    reach = asked.withColumn("reach", in_reach).withColumn("cut", F.array_min(F.transform("reach", lambda b: b["bin"]))).where("cut is not null")
    reach = materialize(reach.select("id", "v", "bound", "cut"), "queries")
    blocks = {r["cut"]: -(-r["n"] // query_rows) for r in reach.groupBy("cut").agg(F.count("*").alias("n")).collect()}
    cuts = sorted(blocks)
    first = dict(zip(cuts, accumulate((blocks[c] for c in cuts), initial=0), strict=False))  # blocks ascend with their cut
    reached_by = {b: sum(blocks[c] for c in cuts if c <= b) for b in parts}  # so those that reach a bin are the first ones

    def by_bin(values: dict[int, int], of: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(y) for pair in sorted(values.items()) for y in pair]), of) if values else F.lit(1)

    block = by_bin(first, F.col("cut")) + F.pmod(F.xxhash64("id"), by_bin(blocks, F.col("cut"))).cast("int")
    q_side = (
        reach.withColumn("b", F.explode(F.filter(bins, lambda b: b["bin"] >= F.col("cut"))))
        .select("id", "v", "bound", block.alias("qb"), F.col("b.bin").alias("bin"), F.explode(F.expr("sequence(0, b.parts - 1)")).alias("part"))
    )
    n_blocks = by_bin(reached_by, F.col("bin"))
    p_side = binned.withColumn("m", n_blocks).where("m > 0").select(
        "id", "v", "bin", F.pmod(F.xxhash64("id", F.lit(7)), by_bin(parts, F.col("bin"))).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("qb"),
    )

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if q.num_rows and p.num_rows:
            q_ids = np.asarray(q["id"].to_numpy(), np.int64)
            a, b = _same_width(_matrix(q["v"], scale), _matrix(p["v"], scale))
            bucket = Bucket(np.asarray(p["id"].to_numpy(), np.int64), b)
            bounds = q["bound"].to_numpy()
            out = [(q_ids[i], ids, s) for i, ids, s in search_bucket(q_ids, a, bounds, bucket, k) if len(ids)]
        return pa.table({
            "query_id": pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64) if out else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([o[1] for o in out]) if out else [], pa.int64()),
            "score": pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.int64()),
        })

    keys = ["qb", "bin", "part"]
    hits = q_side.groupBy(*keys).cogroup(p_side.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
