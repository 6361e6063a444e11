"""Token counts by merging all sequences of a batch in step.

Texts are cut into chunks that no piece crosses. The distinct chunks of a batch lie in ragged numpy
arrays: one array of symbols, one of the sequence each belongs to. In every round each sequence
applies its lowest-ranked pair (the leftmost one, as the library does) at the same time as all
others; sequences without a pair in the vocabulary leave. What survives is counted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import Recent, batch_udf, kept, small_batches, struct_rows, unclashing, utf8, with_result
from voxtide.llm.pieces import Vocabulary, chunks, symbols

LONG = 192  # longer sequences are merged one by one with a heap, in n log n steps
NEVER = np.iinfo(np.int32).max


class Merger:
    """Ranked pairs of a vocabulary, by ids of their two symbols."""

    def __init__(self, vocabulary: Vocabulary):
        ids, scores = vocabulary.ids, vocabulary.scores
        order = {p: r for r, p in enumerate(sorted(ids, key=lambda p: (-scores[p], ids[p])))}
        self.number = {p: i for i, p in enumerate(order)}  # a symbol's number is its rank
        keys, merged = [], []
        for piece, i in self.number.items():
            for cut in range(1, len(piece)):
                a, b = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        by = np.argsort(np.array(keys, np.int64))
        # a last entry that matches nothing keeps searches inside the table
        self.keys = np.append(np.array(keys, np.int64)[by], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int32)[by], NEVER).astype(np.int32)
        self.pairs = dict(zip(keys, merged, strict=True))
        self.alphabet = np.full(0x110000, -1, np.int32)
        for c, i in self.number.items():
            if len(c) == 1:
                self.alphabet[ord(c)] = i

    def first(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters of all texts, and the sequence each belongs to.

        A character without a piece becomes one symbol below 0 per byte.
        """
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sym = self.alphabet[codes]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        if (sym < 0).any():
            spelled = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            times = np.where(sym < 0, spelled, 1)
            sym, owner = np.repeat(sym, times), np.repeat(owner, times)
        return sym, owner

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = np.iinfo(np.int64).max - 1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], NEVER)

    def long(self, s: list[int]) -> int:
        """Symbols left of one long sequence."""
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get

        def pair(i: int):
            j = after[i]
            if j < n and s[i] >= 0 and s[j] >= 0 and (m := get(s[i] << 32 | s[j])) is not None:
                heapq.heappush(heap, (m, i, s[i], s[j]))

        heap: list = []
        for i in range(n - 1):
            pair(i)
        left, gone = n, [False] * n
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if j >= n or s[i] != a or s[j] != b:
                continue
            s[i], gone[j] = m, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            if before[i] >= 0:
                pair(before[i])
            pair(i)
        return left

    def counts(self, texts: list[str]) -> list[int]:
        """Symbols left of each text."""
        sym, owner = self.first(texts)
        out = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        long = np.flatnonzero(out > LONG)
        if len(long):
            begin = np.concatenate([[0], np.cumsum(out)])
            for i, a, b in zip(long.tolist(), begin[long].tolist(), begin[long + 1].tolist(), strict=True):
                out[i] = self.long(sym[a:b].tolist())
            short = ~np.isin(owner, long)
            sym, owner = sym[short], owner[short]
        rank = np.full(len(sym), NEVER, np.int32)
        if len(sym) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1] = np.where(same, self.ranks(sym[:-1], sym[1:]), NEVER)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            going = best < NEVER
            out[owner[starts]] = sizes
            if not going.all():  # finished sequences leave
                stay = np.repeat(going, sizes)
                sym, owner, rank = sym[stay], owner[stay], rank[stay]
                if not len(sym):
                    break
                sizes, best = sizes[going], best[going]
                starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            own = owner[hits]
            at = hits[np.concatenate([[True], own[1:] != own[:-1]])]  # the leftmost of each sequence
            sym[at] = best
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # places after the right halves are gone
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            fresh = np.concatenate([moved, moved[moved > 0] - 1])
            right = np.minimum(fresh + 1, len(sym) - 1)
            ok = (right > fresh) & (owner[fresh] == owner[right])
            rank[fresh] = np.where(ok, self.ranks(sym[fresh], sym[right]), NEVER)
        return out.tolist()


FIELDS = [("n_bytes", pa.int64()), ("n_tokens", pa.int64())]


def count_tokens(docs: DataFrame, model: str, text: str = "text", keep: Iterable[str] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """Columns `keep`, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    `model` is a file of the sentencepiece library with merge ranks and pieces for all bytes, which
    every task can open. Null and empty texts have no tokens. Repeated rows give repeated results;
    other columns are not looked at. A text may be of any length. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    def work(values: list) -> pa.Array:
        merger, cache = kept(f"merger {model}", lambda: (Merger(Vocabulary.load(model)), Recent()))
        parts = [chunks(v or b"") for v in values]
        new = cache.missing(chain.from_iterable(parts))
        cache.now.update(zip(new, merger.counts(list(map(symbols, new))), strict=True))
        get = cache.now.__getitem__
        out = [len(v or b"") for v in values], [sum(map(get, p)) for p in parts]
        cache.turn()
        return struct_rows(FIELDS, out)

    counted = with_result(docs, batch_udf(work, "struct<n_bytes:bigint,n_tokens:bigint>")(utf8(text)), unclashing(keep, ["over_limit"]), [name for name, _ in FIELDS])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
