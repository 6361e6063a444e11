"""Removal of benchmark passages from training texts.

Every window of 13 consecutive words of a benchmark item is hashed. Sorted arrays of these hashes
are broadcast in slices of bounded size; the windows of each document are hashed with a handful of
array operations, looked up, and hits are compared word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import U64, WORD_BYTES, batch_udf, free_name, kept, mixed, plain_words, small_batches, struct_rows, unclashing, utf8
from voxtide.session import materialize

WINDOW = 13
SLICE_BYTES = 16_000_000  # of benchmark text per broadcast: under 100 MB as arrays


class Windows:
    """The distinct windows of some benchmark items: sorted hashes, a place in one array of words, and their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = WINDOW):
        self.numbers: dict[bytes, int] = {}  # benchmark words from 1; 0 is any other word
        self.owners = [item for item, _ in items]
        rows = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in plain_words(text)] for _, text in items]
        sizes = np.array([len(r) for r in rows], np.int64)
        self.words = np.concatenate([np.array(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        windows = np.minimum(sizes, size)
        self.lengths: dict[int, tuple[np.ndarray, ...]] = {}  # hashes, places, begins in items, items
        for n in np.unique(windows[windows > 0]).tolist():
            own = np.flatnonzero(windows == n)
            count = sizes[own] - n + 1
            item = np.repeat(own, count)
            place = np.repeat(begins[own] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
            hashes = _hashes([self.words[place + j] for j in range(n)])
            order = np.argsort(hashes, kind="stable")  # so the items of equal windows ascend
            hashes, place, item = hashes[order], place[order], item[order]
            new = np.ones(len(order), bool)  # equal hashes are not enough
            new[1:] = (hashes[1:] != hashes[:-1]) | ~_same(self.words, place[1:], self.words, place[:-1], n)
            listed = new.copy()
            listed[1:] |= item[1:] != item[:-1]
            firsts = np.flatnonzero(new)
            begin = np.append(np.cumsum(listed)[firsts] - 1, listed.sum())
            self.lengths[n] = hashes[firsts], place[firsts], begin, item[listed]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) of every occurrence, ends excluded, and the items they belong to."""
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        spans, found = [], None
        for n, (hashes, place, begin, item) in self.lengths.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)  # windows without foreign words
            if not len(starts):
                continue
            own = _hashes([ids[starts + j] for j in range(n)])
            at = np.searchsorted(hashes, own, "left")
            more = np.flatnonzero(at < len(hashes))
            hit = np.zeros(len(starts), bool)
            while len(more):  # different windows of one hash follow each other
                more = more[hashes[at[more]] == own[more]]
                if not len(more):
                    break
                same = _same(self.words, place[at[more]], ids, starts[more], n)
                hit[more[same]] = True
                more = more[~same]
                at[more] += 1
                more = more[at[more] < len(hashes)]
            if not hit.any():
                continue
            spans.extend((i, i + n) for i in starts[hit].tolist())
            if found is None:
                found = np.zeros(len(self.owners), bool)
            for w in np.unique(at[hit]).tolist():
                found[item[begin[w] : begin[w + 1]]] = True
        return spans, set() if found is None else {self.owners[j] for j in np.flatnonzero(found)} - {None}


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: int) -> np.ndarray:
    """Whether the n entries of `a` from each place `at` are those of `b` from `bt`."""
    out = np.ones(len(at), bool)
    for j in range(n):
        out &= a[at + j] == b[bt + j]
    return out


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    """One hash per window; entry j holds the j-th words of all windows."""
    out = np.zeros(len(columns[0]), U64)
    with np.errstate(over="ignore"):
        for row in columns:
            out = mixed(out * U64(0x9E3779B97F4A7C15) + row.astype(U64))
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


FIELDS = [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
SCHEMA = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"


def _slices(benchmark: DataFrame, item: str, text: str, slice_bytes: int) -> tuple[int, DataFrame]:
    """The number of slices of about that size, and the benchmark with the slice of each row."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), utf8(text).alias("body")).where(F.length("body") > 0)
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    n = max(1, -(-total // slice_bytes))
    return n, rows.withColumn("slice", F.pmod(F.xxhash64("body", "item"), F.lit(n)))


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    column: str = "hits", slice_bytes: int = SLICE_BYTES, size: int = WINDOW,
) -> DataFrame:
    """The documents with a struct column of (n_words, starts, ends, items).

    starts and ends are word positions of maximal hit spans; items are the ids, as sorted strings,
    of all benchmark items of which a window occurs. A window has `size` words; an item with fewer,
    but at least one, is one window of its own length. Words are runs of ASCII letters and digits
    and characters beyond ASCII, with A-Z lowered. Null and empty texts have no words. Benchmark
    rows with null or empty text have no windows; those with a null id count as hits but are not
    listed. Repeated benchmark rows change nothing; repeated documents give repeated results. All
    columns of the documents are kept; `column` must be a name of its own.

    The benchmark is broadcast in slices of about `slice_bytes` of text, chosen by a hash. One slice
    means one pass without a shuffle. With more, each slice is a pass of its own whose result is
    written to the shared folder, so that a task holds one slice only.
    """
    if column in docs.columns:
        raise ValueError(f"column {column} exists already")
    spark = docs.sparkSession
    small_batches(spark)
    n_slices, rows = _slices(benchmark, item, item_text, slice_bytes)

    def scanner(i: int) -> Column:
        own = rows.where(F.col("slice") == i).select("item", "body").toArrow().to_pydict()
        items = spark.sparkContext.broadcast(list(zip(own["item"], map(bytes, own["body"]), strict=True)))
        key = f"windows {uuid.uuid4().hex}"

        def work(values: list) -> pa.Array:
            windows, out = kept(key, lambda: Windows(items.value, size)), []
            for value in values:
                words = plain_words(value or b"")
                spans, found = windows.scan(words)
                spans = _joined(spans)
                out.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(found)))
            return struct_rows(FIELDS, zip(*out, strict=True) if out else [[]] * 4)

        return batch_udf(work, SCHEMA)(utf8(text))

    if n_slices == 1:
        return docs.withColumn(column, scanner(0))
    parts: list[str] = []
    for i in range(n_slices):
        parts.append(free_name([*docs.columns, column, *parts], f"_{column}_{i}"))
    both = docs
    for i, name in enumerate(parts):
        both = materialize(both.withColumn(name, scanner(i)), "passages")
    return both.withColumn(column, _together([F.col(p) for p in parts])).drop(*parts)


def _together(parts: list[Column]) -> Column:
    """Union of the spans and items found by all slices."""
    spans = F.array_sort(F.flatten(F.array(*[F.zip_with(p["starts"], p["ends"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))) for p in parts])))
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b")))
        )
        return F.when((F.size(done) > 0) & (s["a"] <= F.get(done, F.size(done) - 1)["b"]), grown).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate(spans, empty, add)
    return F.struct(
        parts[0]["n_words"].alias("n_words"), merged["a"].alias("starts"), merged["b"].alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in parts])))).alias("items"),
    )


def _n_hit(hits: Column) -> Column:
    return F.aggregate(
        F.zip_with(hits["starts"], hits["ends"], lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x
    )


def contaminated(hits: Column) -> Column:
    """Whether at least a twentieth of the words lies inside benchmark windows."""
    return (_n_hit(hits) > 0) & (20 * _n_hit(hits) >= hits["n_words"])


def judge(docs: DataFrame, benchmark: DataFrame, keep: Iterable[str] = ("doc_id",), **options) -> DataFrame:
    """Columns `keep`, n_words, n_hit, n_items, items_sha256 (of the listed ids, comma-joined) and contaminated.

    A name in `keep` that is one of the results' is an error.
    """
    keep = unclashing(keep, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    column = options.pop("column", None) or free_name(docs.columns, "hits")
    hits = F.col(column)
    return find_passages(docs, benchmark, column=column, **options).select(
        *keep, hits["n_words"].alias("n_words"), _n_hit(hits).alias("n_hit"), F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), contaminated(hits).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, as they are."""
    column = options.pop("column", None) or free_name(docs.columns, "hits")
    found = find_passages(docs, benchmark, column=column, **options)
    return found.where(~contaminated(F.col(column))).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, with the hit words and what stands between them cut out of the text.

    What stands before the first and after the last word of a span stays. Null texts stay null.
    """
    column = options.pop("column", None) or free_name(docs.columns, "hits")
    found, hits = find_passages(docs, benchmark, text=text, column=column, **options), F.col(column)

    def work(rows: list) -> pa.Array:
        return pa.array([None if r["t"] is None else _cut(r["t"], r["s"], r["e"]).decode() for r in rows], pa.string())

    cut = batch_udf(work, "string")(F.struct(utf8(text).alias("t"), hits["starts"].alias("s"), hits["ends"].alias("e")))
    return found.withColumn(text, cut).select(*docs.columns)


def _cut(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    is_word = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[at : begin[a]])
        at = end[b - 1]
    return b"".join([*out, text[at:]])
