"""Language identification by cross-parsing entropy.

For every language a suffix automaton of some labelled text knows all its substrings. A text is
parsed greedily into the longest phrases that occur in the labelled text; the language that needs
the fewest phrases per letter wins. Texts are parsed from many places side by side: one step moves
the automaton states of all places of a batch by one letter. A parse goes on into the stretch of
the next place until both begin a phrase at the same letter; from there on they are the same, so
the phrases are those of one parse of the whole text.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.llm.common import U64, batch_udf, kept, mixed, small_batches, struct_rows, utf8
from voxtide.session import materialize

LANGUAGE_LETTERS = 40_000  # characters of the labelled texts of each language, which are taken whole
SAMPLE_TEXTS = 150  # texts per language
GROUP = 32  # languages that a worker holds at once; more are looked at in several passes
DENSE = 16_000_000  # entries of full tables that a worker holds; above, only the entries in use
STRIDE = 400  # letters between the places of a text from which it is parsed; changes no result
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower-case code point."""
    letters = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.int32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            letters[code] = True
            low = c.lower()
            if len(low) == 1:
                lower[code] = ord(low)
    return letters, lower


def letters_of(text: bytes) -> np.ndarray:
    """Lower-case code points of the letters, with one blank for whatever stands between them."""
    letters, lower = _characters()
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    is_letter = letters[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of others becomes a blank
    out = np.where(is_letter, lower[codes], 32)[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


class Sparse:
    """The entries of a table that are not 0, by open addressing; half of the slots at least are free."""

    dtype = np.int64

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        n = 1 << max(4, (2 * len(keys)).bit_length())
        self.last, self.keys, self.values = U64(n - 1), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys the last one stays
            stays = self.keys[slots] == keys
            self.values[slots[stays]] = values[stays]
            keys, values, slots = keys[~stays], values[~stays], slots[~stays] + U64(1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys.astype(U64)) & self.last

    def __getitem__(self, entries: np.ndarray) -> np.ndarray:
        entries = np.asarray(entries, np.int64)
        slots = self._slots(entries)
        held = self.keys[slots]
        out = np.where(held == entries, self.values[slots], 0)
        rest = np.flatnonzero((held != entries) & (held >= 0))
        slots = slots[rest]
        while len(rest):
            slots = slots + U64(1) & self.last
            held, wanted = self.keys[slots], entries[rest]
            same = held == wanted
            out[rest[same]] = self.values[slots[same]]
            on = ~same & (held >= 0)
            rest, slots = rest[on], slots[on]
        return out


class Automaton:
    """Suffix automaton as a table of next states; state 0 is the root and 0 also means no match.

    Symbol 0 matches nothing. Where a full table is too large, only the entries in use are held.
    """

    def __init__(self, symbols: list[int], size: int, dense: int = DENSE):
        follow: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        rows = np.repeat(np.arange(len(follow)), [len(f) for f in follow])
        columns = np.fromiter((c for f in follow for c in f), np.int64, len(rows))
        values = np.fromiter((s for f in follow for s in f.values()), np.int64, len(rows)) * size
        # entry state * size + symbol holds next state * size
        keys, values = (rows * size + columns)[columns > 0], values[columns > 0]
        if len(follow) * size <= dense:
            self.table = np.zeros(len(follow) * size, np.int32)
            self.table[keys] = values
        else:
            self.table = Sparse(keys, values)
        self.size = size


def _step(table, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a phrase begins at the letter, and the states behind it."""
    new = table[state + symbol]
    miss = new == 0  # the phrase ends before this letter, or the letter occurs nowhere and is one of its own
    begins = miss | (state == 0)
    again = np.flatnonzero(miss)
    new[again] = table[symbol[again]]
    return begins, new


def _go_on(table, state, after, symbols, grid, begun, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Parses that go on into the next piece until they are in step with its own parse.

    `state` is that before the first letter of the pieces `after`. Returns the phrases that begin
    there less those that the own parse begins at these letters, and the places in `after` of the
    pieces that end before both are in step.
    """
    extra = np.zeros(len(after), np.int64)
    on = np.arange(len(after))
    for step in range(len(grid)):
        if not len(on):
            break
        inside = sizes[after[on]] > step
        if not inside.all():
            # the text ends here, so nothing follows
            on, state = on[inside], state[inside]
        own = begun[step, after[on]]
        begins, new = _step(table, state, symbols[grid[step, after[on]]])
        apart = ~(begins & own)
        on, state = on[apart], new[apart]
        extra[on] += begins[apart].astype(np.int64) - own[apart]
    return extra, on


class Languages:
    """Automata, each over all letters of its own sample; symbol 0 is every letter outside it."""

    def __init__(self, samples: list[tuple[str, list[bytes]]]):
        texts = []
        for lang, own in samples:
            parts = [part for t in own for part in (letters_of(t), [-1])]
            texts.append((lang, np.concatenate(parts or [[]]).astype(np.int64)))
        codes = np.unique(np.concatenate([t for _, t in texts] or [np.zeros(0, np.int64)]))
        codes = codes[codes >= 0]
        self.number = np.zeros(0x110000, np.int32)  # of a letter among those of all samples
        self.number[codes] = np.arange(1, len(codes) + 1)
        self.names = [lang for lang, _ in texts]
        self.automata, self.symbols = [], []  # and by language, the symbols of those numbers
        for _, t in texts:
            own = np.unique(t[t >= 0])
            symbol = np.zeros(len(codes) + 1, np.uint16 if len(own) < 1 << 16 else np.int32)
            symbol[self.number[own]] = np.arange(1, len(own) + 1)
            numbers = np.where(t >= 0, self.number[t], 0)  # 0 between texts
            self.symbols.append(symbol)
            self.automata.append(Automaton(symbol[numbers].tolist(), len(own) + 1, DENSE // len(texts)))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text (rows) needs in each language (columns)."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        owner, pieces = [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), STRIDE):
                owner.append(i)
                pieces.append(t[a : a + STRIDE])
        if not pieces:
            return out
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        column = np.empty(len(pieces), np.int64)
        column[order] = np.arange(len(pieces))
        owner, sizes = np.array(owner), sizes[order]
        grid = np.zeros((STRIDE, len(pieces)), np.int32)
        for k, i in enumerate(order.tolist()):
            grid[: len(pieces[i]), k] = self.number[pieces[i]]
        width = np.searchsorted(-sizes, -np.arange(STRIDE), "left")  # pieces with a letter at each step
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # pieces that go on with the text of the piece before
        before, after = column[later - 1], column[later]
        for k, (automaton, symbols) in enumerate(zip(self.automata, self.symbols, strict=True)):
            table = automaton.table
            state = np.zeros(len(pieces), table.dtype)
            begun = np.zeros(grid.shape, bool)  # whether a phrase begins at the letter
            for step in range(int(sizes[0])):
                n = width[step]
                symbol = symbols[grid[step, :n]]
                begun[step, :n], state[:n] = _step(table, state[:n], symbol)
            count = begun.sum(0)
            extra, open_ = _go_on(table, state[before], after, symbols, grid, begun, sizes)
            if len(open_):
                self._go_on_in_order(table, symbols, grid, begun, sizes, state, before, after, extra, open_)
            count[after] += extra
            out[:, k] = np.bincount(owner, count[column], len(texts)).astype(np.int64)
        return out

    @staticmethod
    def _go_on_in_order(table, symbols, grid, begun, sizes, state, before, after, extra, open_) -> None:
        """Where a parse did not fall into step within a piece, the pieces behind it one after the other.

        `before`, `after` and `extra` are in the order of the texts. Changes `extra` of these pieces.
        """
        look = table.item if isinstance(table, np.ndarray) else lambda entry: int(table[np.array([entry])][0])
        stray, done = set(open_.tolist()), 0
        for i in sorted(stray):
            if i < done:
                continue
            now, at, more = int(state[before[i]]), i, True
            while more:
                place, n, own, met = int(after[at]), 0, 0, False
                letters, starts = symbols[grid[: sizes[place], place]].tolist(), begun[: sizes[place], place].tolist()
                for symbol, start in zip(letters, starts, strict=True):
                    new = look(now + symbol)
                    begins = now == 0 or new == 0
                    if begins and start:
                        met = True
                        break
                    n, own = n + begins, own + start
                    now = new or look(symbol)
                extra[at] = n - own
                at += 1
                more = at < len(after) and before[at] == place and (not met or at in stray)
                if met:  # the piece ends as its own parse does
                    now = int(state[place])
            done = at

    def nearest(self, texts: list[bytes | None]) -> tuple[list[str | None], list[int | None], list[int | None]]:
        """The best language, its phrases and those of the second; nulls where there is none."""
        found = [letters_of(t or b"") for t in texts]
        needed = self.phrases(found)
        names, firsts, seconds = [], [], []
        for letters, row in zip(found, needed.tolist(), strict=True):
            if not len(letters) or not row:
                names.append(None)
                firsts.append(None)
                seconds.append(None)
                continue
            best = min(range(len(row)), key=lambda k: (row[k], self.names[k]))
            names.append(self.names[best])
            firsts.append(row[best])
            seconds.append(min((r for k, r in enumerate(row) if k != best), default=None))
        return names, firsts, seconds


def held_out(id: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id's text leaves no remainder; rows without an id are not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, list[bytes]]]:
    """Labelled texts of every language, whole: of the SAMPLE_TEXTS rows whose ids hash lowest, the first
    that have LANGUAGE_LETTERS characters together.

    Rows with a null id, text or label and held-out rows are left out, as are texts without a letter.
    Texts of more than LANGUAGE_LETTERS characters are taken only where a label has no others, and then
    the shortest. A repeated row counts as often as it occurs among the SAMPLE_TEXTS and is learned once.
    So the driver holds LANGUAGE_LETTERS characters per label, or one text. Only rows are left out, no
    text is cut. Rows are chosen on narrow columns; the texts of the chosen ones are fetched afterwards.
    """
    train = docs.where(~held_out(F.col(id)) & F.col(id).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = train.where(F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(id).alias("h"), F.col(id).alias("id"), F.xxhash64(text).alias("digest"), F.length(text).alias("n")
    )
    order = [F.greatest(F.col("n") - LANGUAGE_LETTERS, F.lit(0)), "h", "id", "digest"]
    by_hash = W.partitionBy("lang").orderBy(*order)
    ranked = rows.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= SAMPLE_TEXTS).drop("r").distinct()
    ranked = ranked.withColumn("r", F.row_number().over(by_hash)).withColumn("sum", F.sum("n").over(by_hash.rowsBetween(W.unboundedPreceding, 0)))
    chosen = materialize(ranked.where((F.col("sum") <= LANGUAGE_LETTERS) | (F.col("r") == 1)).select("lang", "id", "digest", "r"), "sample")
    texts = train.select(F.col(lang).alias("lang"), F.col(id).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("body"))
    found = texts.join(chosen, ["lang", "id", "digest"]).groupBy("lang", "r").agg(F.min("body").alias("body"))
    sample: dict[str, list[bytes]] = {}
    for r in found.orderBy("lang", "r").select("lang", utf8("body").alias("body")).collect():
        sample.setdefault(r["lang"], []).append(bytes(r["body"]))
    return sorted(sample.items())


FIELDS = [("lang", pa.string()), ("first", pa.int64()), ("second", pa.int64())]


def _nearest(docs: DataFrame, samples: list[tuple[str, list[bytes]]], text: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    key = f"languages {uuid.uuid4().hex}"

    def work(values: list) -> pa.Array:
        languages = kept(key, lambda: Languages(shared.value))
        return struct_rows(FIELDS, languages.nearest(values))

    return batch_udf(work, "struct<lang:string,first:bigint,second:bigint>")(utf8(text))


def predict_language(docs: DataFrame, samples: list[tuple[str, list[bytes]]], text: str = "text", column: str = "language") -> DataFrame:
    """The documents with a struct column of (lang_pred, score).

    lang_pred is a label of the samples, or `und` for null texts, texts without a letter, or without
    any sample; ties go to the first label. score is 1 - phrases of the best / phrases of the second
    language, so 0 to 1. All columns are kept; `column` must be a name of its own. Nothing is shuffled.
    With more than GROUP languages the documents are read once for every GROUP, and written between.
    """
    if column in docs.columns:
        raise ValueError(f"column {column} exists already")
    small_batches(docs.sparkSession)
    samples = sorted(samples)
    new, out = f"{column} of group", docs.withColumn(column, _nearest(docs, samples[:GROUP], text))
    for at in range(GROUP, len(samples), GROUP):
        out = materialize(out, "languages").withColumn(new, _nearest(docs, samples[at : at + GROUP], text))
        a, b = F.col(f"`{column}`"), F.col(f"`{new}`")
        # earlier groups hold the smaller labels, so they win ties
        merged = F.when(b["first"] < a["first"], F.struct(b["lang"].alias("lang"), b["first"].alias("first"), F.least(b["second"], a["first"]).alias("second")))
        merged = merged.otherwise(F.struct(a["lang"].alias("lang"), a["first"].alias("first"), F.least(a["second"], b["first"]).alias("second")))
        out = out.withColumn(column, merged).drop(new)
    best = F.col(f"`{column}`")
    score = F.when(best["lang"].isNull(), 0.0).when(best["second"].isNull(), 1.0).otherwise(1 - best["first"] / best["second"])
    return out.withColumn(column, F.struct(F.coalesce(best["lang"], F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score")))


def is_held_out(id: object, folds: int = 5) -> bool:
    """The same rule for a value in Python."""
    return zlib.crc32(str(id).encode()) % folds == 0
