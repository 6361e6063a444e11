"""Dimensionality reduction of sparse or dense vectors."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sparse_columns(df: DataFrame, features: str, keep: Sequence[str]) -> DataFrame:
    """Vectors as arrays `indices` and `values`, the form that goes to Python tasks."""
    raw = F.unwrap_udt(features)
    dense = F.transform(F.filter(raw["values"], lambda x: F.lit(True)), lambda _, i: i)
    return df.select(*keep, F.coalesce(raw["indices"], dense).alias("indices"), raw["values"].alias("values"))


def densify(indices: pd.Series, values: pd.Series, width: int) -> np.ndarray:
    """Rows of (indices, values) as a dense block."""
    sizes = indices.str.len().to_numpy()
    block = np.zeros((len(sizes), width))
    if sizes.sum():
        row = np.repeat(np.arange(len(sizes)), sizes)
        block[row, np.concatenate(indices.to_numpy())] = np.concatenate(values.to_numpy())
    return block


CHUNK = 512  # rows made dense at a time
FEW = 24  # up to so many columns, products with sparse rows are faster without making them dense


class Block:
    """Rows of (indices, values) as a matrix; products with few columns read only the entries that are there."""

    def __init__(self, sizes: np.ndarray, column: np.ndarray, value: np.ndarray, width: int):
        self.rows, self.width, self._dense = len(sizes), width, None
        self.row, self.column, self.value = np.repeat(np.arange(len(sizes)), sizes), column, value

    def dense(self) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros((self.rows, self.width))
            self._dense[self.row, self.column] = self.value
        return self._dense

    def times(self, w: np.ndarray) -> np.ndarray:
        """X·w for w of width × n."""
        if w.shape[1] > FEW:
            return self.dense() @ w
        return np.array([np.bincount(self.row, self.value * c[self.column], self.rows) for c in np.ascontiguousarray(w.T)]).T

    def summed(self, s: np.ndarray, square: bool = False) -> np.ndarray:
        """sᵀ·X for s of rows × n; with the squares of the entries on demand."""
        if s.shape[1] > FEW:
            return s.T @ (self.dense() ** 2 if square else self.dense())
        value = self.value**2 if square else self.value
        return np.array([np.bincount(self.column, value * c[self.row], self.width) for c in np.ascontiguousarray(s.T)])


def _parts(indices: pd.Series, values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = indices.str.len().to_numpy().astype(np.int64)
    if not sizes.sum():
        return sizes, np.zeros(0, dtype=np.int32), np.zeros(0)
    return sizes, np.concatenate(indices.to_numpy()), np.concatenate(values.to_numpy())


def blocks_of(batch: pd.DataFrame, width: int, rows: int = CHUNK) -> Iterator[Block]:
    for at in range(0, len(batch), rows):
        part = batch.iloc[at : at + rows]
        yield Block(*_parts(part["indices"], part["values"]), width)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers that are not negative in one or two bytes each, if they fit."""
    if not len(numbers):
        return numbers
    for kind in (np.uint8, np.uint16):
        if 0 <= numbers.min() and numbers.max() <= np.iinfo(kind).max:
            short = numbers.astype(kind)
            return short if np.array_equal(short, numbers) else numbers
    return numbers


def packed(data: DataFrame, keep: Sequence[str] = (), rows: int = CHUNK, even: bool = False) -> RDD[bytes]:
    """Rows of (indices, values) and numbers as pickled arrays of some hundred rows, for jobs that read them many times.

    `even` deals them out anew, for jobs of many steps per row on tables of few or unequal partitions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [batch.iloc[at : at + rows] for at in range(0, len(batch), rows)]
            yield pd.DataFrame({"part": [pickle.dumps(([_narrow(x) for x in _parts(p["indices"], p["values"])], [p[c].to_numpy() for c in keep]), 5) for p in parts]})

    parts = data.mapInPandas(run, "part binary")
    if even:
        parts = parts.repartition(max(4 * data.sparkSession.sparkContext.defaultParallelism, data.rdd.getNumPartitions()))
    return parts.rdd.map(lambda r: bytes(r["part"])).persist(StorageLevel.MEMORY_AND_DISK)


def sum_of_packed(data: RDD[bytes], width: int, work: Callable, shape: tuple[int, int]) -> np.ndarray:
    """Add up a matrix that `work(out, block, *kept columns)` adds to; matrices are added on the executors."""

    def run(parts: Iterator[bytes]) -> Iterator[np.ndarray]:
        out = np.zeros(shape)
        for part in parts:
            (sizes, column, value), kept = pickle.loads(part)
            work(out, Block(sizes.astype(np.int64), column.astype(np.int32), value.astype(np.float64), width), *kept)
        yield out

    matrices = data.mapPartitions(run)
    return matrices.treeReduce(np.add) if data.getNumPartitions() else np.zeros(shape)


def dense_blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            yield densify(part["indices"], part["values"], width)


def sum_over_tasks(data: DataFrame, work: Callable[[Iterator[np.ndarray]], np.ndarray], width: int) -> np.ndarray:
    """Add up a matrix that each task computes from its dense blocks of rows.

    Only the matrix leaves a task; matrices are added on the executors.
    """

    return sum_of_matrices(data, lambda batches: work(dense_blocks(batches, width)))


def sum_of_matrices(data: DataFrame, work: Callable[[Iterator[pd.DataFrame]], np.ndarray]) -> np.ndarray:
    """As `sum_over_tasks`, for work on the batches themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = work(batches)
        yield pd.DataFrame({"row": np.arange(len(matrix), dtype="int32"), "part": list(matrix)})

    parts = data.mapInPandas(run, "row int, part array<double>")
    # few rows and many tasks: partial sums of groups of tasks first, then of the groups
    vector = parts.withColumn("some", F.spark_partition_id() % 64).withColumn("part", array_to_vector("part"))
    partial = vector
    if data.rdd.getNumPartitions() > 64:
        partial = vector.groupBy("row", "some").agg(Summarizer.sum(F.col("part")).alias("part"))
    summed = partial.groupBy("row").agg(Summarizer.sum(F.col("part")).alias("total"))
    table = summed.select("row", vector_to_array("total").alias("total")).toArrow()
    order = np.argsort(table["row"].to_numpy())
    return np.array(table["total"].combine_chunks().flatten()).reshape(len(order), -1)[order]


def svd_basis(df: DataFrame, width: int, features: str = "features", k: int = 50, oversample: int = 10,
              passes: int = 7, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Largest k singular values and right singular vectors (width × k) of the row matrix.

    Randomised subspace iteration (Halko, Martinsson, Tropp 2011): each pass over the
    rows returns XᵀXQ for a thin basis Q, which the driver makes orthonormal again.
    """
    size = min(k + oversample, width)
    spark = df.sparkSession
    data = sparse_columns(df, features, []).cache()
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))
    for step in range(passes):
        sent = spark.sparkContext.broadcast(basis)
        last = step == passes - 1

        def work(blocks: Iterator[np.ndarray]) -> np.ndarray:
            q = sent.value
            out = np.zeros((size, size if last else width))
            for block in blocks:
                image = block @ q
                out += image.T @ (image if last else block)
            return out

        found = sum_over_tasks(data, work, width)
        sent.unpersist()
        if not last:
            basis, _ = np.linalg.qr(found.T)
    data.unpersist()
    values, vectors = np.linalg.eigh((found + found.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0.0)), basis @ vectors[:, order]


def project(df: DataFrame, basis: np.ndarray, features: str = "features", keep: Sequence[str] = ("doc_id",),
            output: str = "reduced") -> DataFrame:
    """Multiply each row by a (d × k) basis that is sent to the tasks once."""
    sent = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(basis))
    sparse = sparse_columns(df, features, keep)
    schema = T.StructType([sparse.schema[c] for c in keep]).add(output, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = sent.value
        for batch in batches:
            images = [block @ weights for block in dense_blocks(iter([batch]), weights.shape[0])]
            yield batch[list(keep)].assign(**{output: [row for image in images for row in image]})

    return sparse.mapInPandas(run, schema)


def truncated_svd(df: DataFrame, width: int, features: str = "features", keep: Sequence[str] = ("doc_id",),
                  k: int = 50, output: str = "reduced") -> DataFrame:
    """Rows in the space of the k largest singular vectors (scaled by the singular values)."""
    _, basis = svd_basis(df, width, features, k)
    # The sign of a singular vector is arbitrary: make its largest entry positive.
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return project(df, basis * signs, features, keep, output)


def pca(df: DataFrame, features: str = "features", keep: Sequence[str] = ("doc_id",), k: int = 2,
        output: str = "reduced") -> DataFrame:
    """Coordinates on the k main axes."""
    model = PCA(k=k, inputCol=features, outputCol="_pca").fit(df.select(features))
    # Spark multiplies without centring; subtract the projected mean.
    out = model.transform(df).select(*keep, vector_to_array("_pca").alias("_a"))
    means = out.agg(*[F.avg(F.col("_a")[i]).alias(f"m{i}") for i in range(k)]).first()
    return out.select(*keep, F.array(*[F.col("_a")[i] - F.lit(means[i]) for i in range(k)]).alias(output))
