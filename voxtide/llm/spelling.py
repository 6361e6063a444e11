"""Spelling variants: frequent words and the far more frequent words one edit away from them.

Words one insertion, deletion or replacement apart are found in a bit-sliced position index. For
every (position, letter) it holds a bitset over the words of a block; a query reads its letters from
left to right and keeps, for 64 words at a time, the set of words that have agreed so far and the set
of words that have agreed but for one edit. A replacement keeps position and letter in step; after a
deletion the position looked at is one behind the query's.

Two words one edit apart share the first or the last h letters, h being half the length of the
shorter one, rounded down. So words meet in groups of equal length of the shorter word and equal
first (or last) h letters. Small groups share blocks; a group larger than a block is dealt over
index parts and query parts that meet pairwise, so that no task holds a whole hot group. What
leaves a task is one row per word: how many words are near and which of them is the most frequent.

What is defined for odd rows: a null text has no words, a null id counts as the empty string. Runs
of any length are words. Rows that repeat an id are texts of their own. Columns of any other name
may be there and are ignored. Without words the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import small_batches
from voxtide.session import materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 2048  # words of a block's index, and queries that meet it at once
BLOCK_LETTERS = 1 << 17  # letters of an index; long words make smaller blocks
U64 = np.uint64
FOUND = "word string, n_near bigint, form_n bigint, form string"


def lowered_runs(text: str | Column) -> Column:
    """All runs of letters of a text, with A-Z lowered; null for a null text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit(RUN), F.lit(0))


def with_slips(run: Column, key: Column, every: int = 199) -> Column:
    """The run, or for one of `every` (key, run) pairs the run without one letter, by a checksum of both."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = 6, min_count: int = 5, slips: int = 199,
) -> DataFrame:
    """(word, n) of all words of at least `min_letters` letters that occur at least `min_count` times.

    Occurrences are counted before the shuffle, so a word that holds a third of all occurrences is
    one row per task.
    """
    runs = docs.select(F.col(key).alias("k"), F.explode(lowered_runs(text)).alias("run"))
    words = runs.where(F.char_length("run") >= min_letters).select(with_slips(F.col("run"), F.col("k"), slips).alias("word"))
    counted = words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over words of one length, per position and letter."""

    def __init__(self, letters: np.ndarray):
        """Words as rows of equally many code points."""
        self.n, self.length = letters.shape
        self.width = -(-self.n // 64)
        codes = (np.arange(self.length, dtype=np.int64) << 21) + letters
        self.codes, row = np.unique(codes, return_inverse=True)
        bits = np.zeros((len(self.codes) + 1, self.width), U64)  # the last row is empty
        word = np.broadcast_to(np.arange(self.n)[:, None], letters.shape).ravel()
        np.bitwise_or.at(bits, (row.ravel(), word // 64), U64(1) << (word % 64).astype(U64))
        self.bits = bits

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter, the words that have it at this position."""
        if not 0 <= position < self.length:
            return np.zeros((len(letters), self.width), U64)
        wanted = (position << 21) + letters.astype(np.int64)
        row = np.searchsorted(self.codes, wanted)
        known = row < len(self.codes)
        known[known] = self.codes[row[known]] == wanted[known]
        return self.bits[np.where(known, row, len(self.codes))]

    def _start(self, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
        everything = np.full((n_queries, self.width), ~U64(0))
        if self.n % 64:
            everything[:, -1] = (U64(1) << U64(self.n % 64)) - U64(1)
        return everything, np.zeros((n_queries, self.width), U64)

    def replaced(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) where a query of the same length differs in exactly one letter."""
        exact, one = self._start(len(queries))
        for i in range(self.length):
            same = self.having(i, queries[:, i])
            one = (one & same) | (exact & ~same)
            exact = exact & same
        return self._pairs(one)

    def shortened(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) where a query one letter longer is the word with one letter put in."""
        exact, one = self._start(len(queries))
        for i in range(self.length + 1):
            one = (one & self.having(i - 1, queries[:, i])) | exact  # agrees one place behind, or this letter is left out
            exact = exact & self.having(i, queries[:, i])
        return self._pairs(one)

    @staticmethod
    def _pairs(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        query, place = np.nonzero(sets)
        bits = np.unpackbits(sets[query, place].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return query[at], place[at] * 64 + bit


def _code_points(words: list[str], length: int) -> np.ndarray:
    joined = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).reshape(len(words), length).astype(np.int64)


def _near_pairs(index: list[str], queries: list[str], length: int, longer: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (query, word) of near words, some blocks at a time."""
    step = max(1, min(BLOCK, BLOCK_LETTERS // max(length, 1)))
    for i in range(0, len(index), step):
        block = PositionIndex(_code_points(index[i : i + step], length))
        for j in range(0, len(queries), step):
            letters = _code_points(queries[j : j + step], length + longer)
            q, w = block.shortened(letters) if longer else block.replaced(letters)
            yield q + j, w + i


def _search(table: pa.Table) -> pa.Table:
    """Near words of all groups in one block: per word their number and the most frequent one."""
    columns = {name: table.column(name).to_pylist() for name in ("length", "front", "role", "word")}
    n = table.column("n").to_numpy()
    by_class: dict[tuple, list[list[int]]] = {}
    for row, (length, front, role) in enumerate(zip(columns["length"], columns["front"], columns["role"], strict=True)):
        by_class.setdefault((length, front), [[], [], []])[role].append(row)
    words = columns["word"]
    found_a, found_b = [], []
    for (length, front), (index, same, long) in by_class.items():
        half = length // 2
        code: dict[str, int] = {}
        share = lambda w: w[:half] if front else w[len(w) - half :]  # noqa: B023, E731
        group = {r: code.setdefault(share(words[r]), len(code)) for rows in (index, same, long) for r in rows}
        for rows, longer in ((same, False), (long, True)):
            at_q, at_w = np.asarray(rows, np.int64), np.asarray(index, np.int64)
            group_q, group_w = (np.fromiter((group[r] for r in some), np.int64, len(some)) for some in (rows, index))
            for q, w in _near_pairs([words[r] for r in index], [words[r] for r in rows], length, longer):
                kept = group_q[q] == group_w[w]
                a, b = at_q[q[kept]], at_w[w[kept]]
                if not front:  # what shares the first letters as well was found there
                    new = np.fromiter((words[x][:half] != words[y][:half] for x, y in zip(a, b, strict=True)), bool, len(a))
                    a, b = a[new], b[new]
                found_a.append(a)
                found_b.append(b)
                if longer:  # the longer word is near the shorter one as well
                    found_a.append(b)
                    found_b.append(a)
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
    numbers: dict[str, int] = {}
    word_of = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    names = list(numbers)
    place = np.empty(len(names), np.int64)  # in code-point order
    place[np.asarray(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(len(names))
    order = np.lexsort((place[word_of[b]], -n[b], word_of[a]))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(word_of[a], prepend=-1))
    counts = np.diff(np.append(first, len(a)))
    return pa.table({
        "word": pa.array([words[r] for r in a[first]], pa.string()), "n_near": pa.array(counts, pa.int64()),
        "form_n": pa.array(n[b[first]], pa.int64()), "form": pa.array([words[r] for r in b[first]], pa.string()),
    })


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have near words: their number and the most frequent.

    Ties go to the smallest in code-point order. Words are distinct.
    """
    size = F.char_length("word")

    def entry(role: int, length: Column, front: bool) -> Column:
        half = F.floor(length / 2).cast("int")
        return F.struct(
            F.lit(role).alias("role"), length.cast("int").alias("length"), F.lit(front).alias("front"),
            F.xxhash64(length.cast("int"), F.lit(front), F.left("word", half) if front else F.right("word", half)).alias("gram"),
        )

    # the index and the queries of its own length have one entry: role 1 stands for both
    entries = words.select("word", "n", F.inline(F.array(*[
        entry(role, size if role == 1 else size - 1, front) for role in (1, 2) for front in (True, False)
    ])))
    grams = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("role") == 1).alias("indexed"))
    grams = materialize(grams.where("indexed > 0 and members > 1"), "grams")  # a group without an index has no pairs
    total = grams.agg(F.sum("members")).first()[0] or 0
    blocks = max(1, total // BLOCK)
    large = F.ceil(F.col("members") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    # one-part groups share the blocks; others have parts * parts blocks of their own
    dealt = entries.join(grams.select("gram", large.alias("parts")), "gram").withColumn("part", part)
    as_index = dealt.where("role = 1").select(
        F.lit(0).alias("role"), "word", "n", "length", "front", "gram", "parts", F.col("part").alias("i"), F.explode(everywhere).alias("q"))
    as_query = dealt.select("role", "word", "n", "length", "front", "gram", "parts", F.explode(everywhere).alias("i"), F.col("part").alias("q"))
    shared = F.col("parts") == 1
    whole = as_index.unionByName(as_query).select(
        shared.alias("shared"), F.when(shared, F.pmod(F.col("gram"), F.lit(blocks))).otherwise(F.col("gram")).alias("block"),
        "i", "q", "role", "length", "front", "word", "n")
    found = whole.groupBy("shared", "block", "i", "q").applyInArrow(_search, FOUND)
    most = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("best"))
    return most.select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words (word, n).

    The form of a word is its most frequent near word, if that occurs at least `times` times as often
    (ties: the smallest in code-point order). The root is where the forms lead, or the word itself.
    Forms grow by `times` with every step, so that a chain has at most log(n) words; roots are
    found by doubling: every round joins each word's goal to the goal of that goal.
    """
    words = materialize(words.select("word", "n"), "words")
    near = materialize(near_words(words), "near")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("form_n") >= times * F.col("n"), F.struct("form", "form_n")).alias("f"),
    )
    known = materialize(known.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    goals = known.where("form is not null").select("word", F.col("form").alias("root"))
    most = known.agg(F.max("n")).first()[0] or 1
    rounds = math.ceil(math.log2(max(2.0, math.log(most, times) + 1))) if times > 1 else 0
    for _ in range(rounds):
        goals = materialize(goals, "goals")
        onward = goals.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        goals = goals.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
    found = known.join(materialize(goals, "roots"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = 6, min_count: int = 5, times: int = 5,
    slips: int = 199,
) -> DataFrame:
    """Words of all texts with their near words, forms and roots; see `word_counts` and `group_variants`."""
    small_batches(docs.sparkSession)
    return group_variants(word_counts(docs, key, text, min_letters, min_count, slips), times)
