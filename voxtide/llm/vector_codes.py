"""Vector compression: each of sixteen parts of a vector becomes the index of its nearest codebook entry.

The nearest entry is found by equal-average search. Entries are sorted by the sum of their
components; from the place of a part's own sum the search goes outward to both sides. By the
Cauchy-Schwarz inequality two parts whose sums differ by g are at least g * g / width apart, so a
side is closed as soon as g * g strictly exceeds width times the best distance found: nothing
beyond it can be nearer or as near. All parts of a batch take their steps together.

Everything is integer: component x becomes floor(scale * x), distances and errors are exact.

What is defined for odd rows: vectors that are null or hold null or non-finite components are left
out. Vectors are filled with zeros up to the longest one, and that to a multiple of the number of
parts. Rows that repeat an id are rows of their own; a null id comes last when the first entries are
chosen, rows of the same id in order of their components. With fewer rows than entries the codebooks
have as many entries as there are rows; without rows they are empty. Columns of any other name may
be there and are ignored. Components whose integer is beyond 2 ** 24 (in parts of over 32 components,
beyond 2 ** 29 / components) are refused, as sums of their squares may leave the range of long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import small_batches, struct_rows
from voxtide.session import materialize

FIELDS = [("code", pa.binary()), ("error", pa.int64()), ("n_compared", pa.int64())]


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & finite


def _integers(vectors: pa.Array, scale: float, n_parts: int, width: int) -> np.ndarray:
    """floor(scale * x) of all vectors, filled with zeros and cut into parts."""
    lengths = np.asarray(vectors.value_lengths()) if len(vectors) else np.zeros(0, np.int64)
    out = np.zeros((len(vectors), n_parts * width), np.int64)
    values = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    if np.abs(values).max(initial=0) > min(1 << 24, (1 << 29) // width):
        raise ValueError("a component is too large to be compressed exactly")
    out[np.arange(n_parts * width) < lengths[:, None]] = values.astype(np.int64)
    return out.reshape(-1, n_parts, width)


@dataclass(frozen=True)
class Codebooks:
    """Entries by (part, entry, position), and the scale of the components."""

    entries: np.ndarray
    scale: float

    @property
    def n_parts(self) -> int:
        return self.entries.shape[0]

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry and squared distance of all parts (rows, part, position), and entries looked at.

        Ties go to the lower entry.
        """
        rows, n_parts, width = parts.shape
        n = self.entries.shape[1]
        sums = self.entries.sum(axis=2)
        order = np.argsort(sums, axis=1, kind="stable")
        sorted_sums = np.take_along_axis(sums, order, axis=1)
        book = np.tile(np.arange(n_parts), rows)
        flat, own = parts.reshape(-1, width), parts.sum(axis=2).ravel()
        place = np.empty((rows, n_parts), np.int64)
        for p in range(n_parts):
            place[:, p] = np.searchsorted(sorted_sums[p], parts[:, p].sum(axis=1))
        best = np.full(len(flat), np.iinfo(np.int64).max)
        chosen = np.full(len(flat), n, np.int64)
        looked = np.zeros(len(flat), np.int64)
        sides = []  # parts whose search still goes on, their next place, and the step to the one after
        for at, step in ((place.ravel(), 1), (place.ravel() - 1, -1)):
            inside = np.flatnonzero((at >= 0) & (at < n))
            sides.append((inside, at[inside], step))
        while any(len(part) for part, _, _ in sides):
            for k, (part, at, step) in enumerate(sides):
                gap = sorted_sums[book[part], at] - own[part]
                within = (chosen[part] == n) | (gap * gap <= width * np.where(chosen[part] == n, 0, best[part]))
                part, at = part[within], at[within]
                entry = order[book[part], at]
                away = flat[part] - self.entries[book[part], entry]
                distance = (away * away).sum(axis=1)
                looked[part] += 1
                nearer = (distance < best[part]) | ((distance == best[part]) & (entry < chosen[part]))
                best[part[nearer]], chosen[part[nearer]] = distance[nearer], entry[nearer]
                at = at + step
                inside = (at >= 0) & (at < n)
                sides[k] = (part[inside], at[inside], step)
        shape = (rows, n_parts)
        return chosen.reshape(shape), best.reshape(shape), looked.reshape(shape)

    def encode(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = _integers(vectors, self.scale, self.n_parts, self.width)
        return parts, *self.nearest(parts)


def first_codebooks(df: DataFrame, vector: str, key: str, n_parts: int, n_entries: int, scale: float) -> Codebooks:
    """Codebooks whose entries are the parts of the rows of smallest id."""
    kept = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-max(longest, 1) // n_parts)
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(n_entries).select("v").toArrow()["v"].combine_chunks()
    whole = _integers(first, scale, n_parts, width)
    return Codebooks(np.ascontiguousarray(whole.transpose(1, 0, 2)), scale)


def _sums(df: DataFrame, books: Codebooks) -> DataFrame:
    """Component sums and counts of the parts that each entry is the nearest of: (cell, total).

    A task returns one row per entry and component, however many vectors it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts, n, width = books.entries.shape
        total, count = np.zeros((n_parts * n, width), np.int64), np.zeros(n_parts * n, np.int64)
        for batch in batches:
            parts, entry, _, _ = books.encode(batch.column(0))
            cell = (entry + np.arange(n_parts) * n).ravel()
            np.add.at(total, cell, parts.reshape(-1, width))
            count += np.bincount(cell, minlength=len(count))
        both = np.concatenate([total, count[:, None]], axis=1)
        seen = np.flatnonzero(np.repeat(count > 0, width + 1))
        yield pa.record_batch({"cell": pa.array(seen, pa.int64()), "total": pa.array(both.ravel()[seen], pa.int64())})

    return df.mapInArrow(run, "cell bigint, total bigint").groupBy("cell").agg(F.sum("total").alias("total"))


def train(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", n_parts: int = 16, n_entries: int = 64, rounds: int = 2,
    scale: float = 256.0,
) -> Codebooks:
    """Codebooks after `rounds` rounds over all rows.

    In a round every part goes to its nearest entry, and every entry becomes the componentwise
    floor(sum / count) of its parts; entries without parts stay. The driver holds the codebooks
    only: n_parts * n_entries * width integers.
    """
    small_batches(df.sparkSession)
    books = first_codebooks(df, vector, key, n_parts, n_entries, scale)
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(usable("v"))
    for _ in range(rounds if books.entries.shape[1] else 0):
        found = _sums(rows, books).toArrow()
        both = np.zeros(n_parts * books.entries.shape[1] * (books.width + 1), np.int64)
        both[found["cell"].to_numpy()] = found["total"].to_numpy()
        both = both.reshape(*books.entries.shape[:2], books.width + 1)
        total, count = both[..., :-1], both[..., -1:]
        books = Codebooks(np.where(count > 0, total // np.maximum(count, 1), books.entries), scale)
    return books


def compress(df: DataFrame, books: Codebooks, vector: str = "embedding", column: str = "compressed") -> DataFrame:
    """All rows with a usable vector, and `column`: a struct of code (bytes), error and n_compared.

    The code holds one byte per part, so there are at most 256 entries. A column of the name of
    `column` is replaced.
    """
    if books.entries.shape[1] > 256:
        raise ValueError("a code has one byte per part")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            _, entry, distance, looked = books.encode(batch)
            codes = [bytes(row) for row in entry.astype(np.uint8)]
            yield struct_rows(FIELDS, [codes, distance.sum(axis=1), looked.sum(axis=1)])

    encode = F.arrow_udf(run, "code binary, error bigint, n_compared bigint").asNondeterministic()
    return df.where(usable(F.col(vector).cast("array<double>"))).withColumn(column, encode(F.col(vector).cast("array<double>")))


def decompress(code: str | Column, books: Codebooks) -> Column:
    """The vector a code stands for, in the scale of the input."""
    c = F.col(code) if isinstance(code, str) else code
    flat = F.lit((books.entries / books.scale).ravel().tolist()).cast("array<double>")
    size = books.entries.shape[1] * books.width

    def part(p: Column) -> Column:
        entry = F.conv(F.hex(F.substring(c, p + 1, F.lit(1))), 16, 10).cast("int")
        return F.slice(flat, p * size + entry * books.width + 1, F.lit(books.width))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(books.n_parts - 1)), part))


def compress_with_errors(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", **settings,
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of all rows with a usable vector.

    `label_error` is the sum of the errors of all rows of the same label, null being one. Errors are
    summed per label before the shuffle; the sums are written out, so that the planner knows their
    size and splits the rows of a hot label where it joins by shuffle.
    """
    books = train(df, vector, key, **settings)
    rows = df.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).alias("v"))
    coded = materialize(compress(rows, books, "v", "c").select("k", "l", "c.code", "c.error"), "codes")
    sums = materialize(coded.groupBy("l").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("l", "m")
    joined = coded.join(sums, F.col("l").eqNullSafe(F.col("m")))
    return joined.select(
        F.col("k").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.sha256()).alias("codebooks_sha256"),
    )
