"""Words, batches and caches shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; texts may be long, so batches are small.
BATCH_ROWS = "512"
SLICE_BYTES = 4_000_000  # of text worked on at once

#: Letters and digits of ASCII and all bytes of other characters are words; A-Z is lowered.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

U64 = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Bound the rows per Arrow batch in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def utf8(text: str | Column) -> Column:
    """A text as UTF-8 bytes; they reach Python without being decoded."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def plain_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, with A-Z lowered."""
    return text.translate(WORD_BYTES).split()


def struct_rows(fields: list[tuple[str, pa.DataType]], columns: Iterable) -> pa.Array:
    """A struct array from one sequence per field."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, k) for n, k in fields])


class Recent:
    """A cache of bounded size: when it is full, only what was used since the last turn survives.

    Values are pure functions of their keys, so what is forgotten changes no result.
    """

    def __init__(self, most: int = 200_000):
        self.most, self.now, self.old = most, {}, {}

    def missing(self, keys: Iterable) -> list:
        """Those of the keys that have no value; the others are fetched from the older half."""
        new = set(keys).difference(self.now)
        if not self.old:
            return list(new)
        old, found = self.old, []
        for key in new:
            if key in old:
                self.now[key] = old[key]
            else:
                found.append(key)
        return found

    def turn(self) -> None:
        """To be called between batches."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now


_KEPT: dict[str, object] = {}


def kept(key: str, build: Callable[[], object]):
    """What `build` returns, made once per worker process; the last few are kept.

    Closures are unpickled for every task, so models and caches live here instead.
    """
    if key not in _KEPT:
        while len(_KEPT) >= 6:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = build()
    return _KEPT[key]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def reuse_buffers() -> None:
    """Let this process keep the memory that array operations give back, up to 128 MB.

    By default the C library returns every large buffer to the system, and asking for it again costs
    more than the operation itself. Elsewhere than on glibc nothing is changed.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD


def slices(values: list, most: int) -> Iterator[list]:
    """Runs of values of about `most` bytes together; a larger value is a run of its own."""
    some, n = [], 0
    for value in values:
        own = len(value) if isinstance(value, bytes) else 0
        if some and n + own > most:
            yield some
            some, n = [], 0
        some.append(value)
        n += own
    if some:
        yield some


def batch_udf(work: Callable[[list], pa.Array], schema: str) -> Callable[..., Column]:
    """A column function that runs `work` on the Python values of each Arrow batch, some MB at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept("buffers", reuse_buffers)
        for batch in batches:
            values = batch.to_pylist()
            done = [work(some) for some in slices(values, SLICE_BYTES)] or [work([])]
            yield done[0] if len(done) == 1 else pa.concat_arrays(done)

    return F.arrow_udf(run, schema).asNondeterministic()


def free_name(taken: Iterable[str], name: str) -> str:
    """The name, with underscores behind it until no column is called so in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def unclashing(keep: Iterable[str], results: Iterable[str]) -> list[str]:
    """The columns to keep, if no result has the name of one of them."""
    keep, taken = list(keep), {r.lower() for r in results}
    if clash := [k for k in keep if k.lower() in taken]:
        raise ValueError(f"columns {clash} have names of results")
    return keep


def with_result(df: DataFrame, column: Column, keep: Iterable[str], results: Iterable[str]) -> DataFrame:
    """Columns `keep` and the fields `results` of a struct column that is computed once per row."""
    keep = unclashing(keep, results)
    row = free_name(keep, "_result")
    return df.select(*[F.col(k) for k in keep], column.alias(row)).select(*keep, f"{row}.*")
