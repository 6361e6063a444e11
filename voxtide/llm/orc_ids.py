"""Token ids in ORC files, in the order of the document ids.

A row holds a document's id, the number of ids before it in its file and its ids as an integer list,
which ORC stores run-length encoded; the files carry row indexes and a Bloom filter on the document
id, so a reader of one document skips files, stripes and row groups. Stripes are read in parallel.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm.common import kept, small_batches, utf8

END_ID = 0
ROW_GROUP = 1024  # rows per entry of the row index
STRIPE_BYTES = 64 * 1024 * 1024
JOINED = 256  # chunks encoded in one call
KNOWN = 350_000  # chunks whose ids a worker keeps
GROUP_BYTES = 2 << 20  # of text encoded together
AS_IS = b"\xff"  # never part of UTF-8

SPACE_RUN = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
OTHER_SPACE = (b"  ", b" \n", b"\n\n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")
ODD_STARTS = (AS_IS, b"\n", b"")
UNCUT, PLAIN, SPACED = range(3)
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
WIDE_STARTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")  # of WIDE_SPACE


class Encoder:
    """The tokenizers library, asked once per distinct chunk.

    The byte-level pre-tokeniser never lets a token run from other text into white space, so a text
    may be cut before each run of white space. Texts with special strings or with white space beyond
    ASCII, and tokenizers that prepare texts in another way, are encoded whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        kind = str(self.library.pre_tokenizer)
        self.cuts = self.library.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        names = {i: name for name, i in self.library.get_vocab().items()}
        self.width = np.array([len(names.get(i, "")) for i in range(max(names) + 1)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}  # number of each chunk that is known
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of its ids in `ids`
        self.ids = np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int64)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def form(self, text: bytes) -> int:
        """Whether a text is not to be cut, has single blanks and line ends only, or other runs of white space."""
        if not self.cuts or any(s in text for s in self.special):
            return UNCUT
        if not text.isascii() and any(s in text for s in WIDE_STARTS) and WIDE_SPACE.search(text):
            return UNCUT
        if not text or any(s in text for s in OTHER_SPACE):
            return SPACED
        return PLAIN

    @staticmethod
    def _marked(text: bytes) -> bytes:
        """A plain text whose chunks are what stands between blanks (see `split`)."""
        return AS_IS + text.replace(b"\n", b" \n")

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        """Chunks of a text. Chunks after a blank stand without it, those that are neither after a
        blank nor a line end have AS_IS before them."""
        return [
            chunk if chunk[:1] == b"\n" else chunk[1:] if chunk[:1] == b" " and chunk[1:2] != b"\n" else AS_IS + chunk
            for chunk in SPACE_RUN.findall(text)
        ]

    def learn(self, chunks: list[bytes]) -> None:
        """Add the ids of chunks that are not known."""
        odd = [k for k in chunks if k[:1] in ODD_STARTS or k[-1:].isspace()]
        lines = [k for k in odd if k[:1] == b"\n" and not k[-1:].isspace()]
        known = set(odd)
        words = [k for k in chunks if k not in known]
        alone = list(known.difference(lines))  # at a text's start, or a following chunk could join its white space
        blocks = [b" " + b" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        blocks = [b.decode() for b in (*blocks, *(b"".join(lines[i : i + JOINED]) for i in range(0, len(lines), JOINED)))]
        lengths = np.fromiter(map(len, words + lines), np.int64, len(words) + len(lines))
        lengths[: len(words)] += 1  # the blank before
        found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(blocks, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        ends = np.cumsum(lengths)
        reached = np.cumsum(self.width[ids])
        at = np.searchsorted(reached, ends) + 1
        if len(ends) and (reached[at - 1] != ends).any():
            raise ValueError("a token crosses white space")
        single = [self.whole(self._literal(key)) for key in alone]
        sizes = np.concatenate([np.diff(at, prepend=0), np.fromiter(map(len, single), np.int64, len(single))]).astype(np.int64)
        self._add(words + lines + alone, sizes, [ids, *single])

    @staticmethod
    def _literal(key: bytes) -> bytes:
        return key[1:] if key[:1] == AS_IS else key if key[:1] == b"\n" else b" " + key

    def _add(self, keys: list[bytes], sizes: np.ndarray, ids: list[np.ndarray]) -> None:
        known = len(self.begin)
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.place.update(zip(keys, range(known, known + len(keys)), strict=True))
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, *ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), np.int64)])

    def turn(self) -> None:
        """Beyond KNOWN chunks, those used most stay. Ids depend on the chunk alone, so nothing else changes."""
        if len(self.place) <= KNOWN:
            return
        keys, uses = list(self.place), self.uses
        kept_ = np.sort(np.argsort(-uses, kind="stable")[: KNOWN // 2])
        size = self.size[kept_]
        ids = self._gather(kept_)
        self.forget()
        self._add([keys[i] for i in kept_.tolist()], size, [ids])
        self.uses = uses[kept_] // 2  # what was used long ago counts for less

    def _gather(self, chunks: np.ndarray) -> np.ndarray:
        """The ids of all chunks in a row."""
        size = self.size[chunks]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.begin[chunks] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def encode_flat(self, texts: list[bytes], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, `end` after each, and how many each text has."""
        texts = [t if _valid(t) else t.decode("utf-8", "replace").encode() for t in texts]
        forms = [self.form(t) for t in texts]
        plain = pa.array([self._marked(t) for t, form in zip(texts, forms, strict=True) if form == PLAIN], pa.binary())
        lists = pc.split_pattern(plain, b" ")
        rest = [self.split(t) for t, form in zip(texts, forms, strict=True) if form == SPACED]
        chunks = pa.concat_arrays([lists.flatten(), pa.array(chain.from_iterable(rest), pa.binary())]).dictionary_encode()
        counts = {PLAIN: iter(lists.value_lengths().to_pylist()), SPACED: iter([len(p) for p in rest])}
        at = {PLAIN: 0, SPACED: len(lists.values)}
        distinct = chunks.dictionary.to_pylist()
        self.learn([c for c in distinct if c not in self.place])
        number = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[chunks.indices.to_numpy()]
        self.uses += np.bincount(number, minlength=len(self.uses))
        flat = self._gather(number)
        cuts = np.concatenate([[0], np.cumsum(self.size[number])])
        out, sizes = [], []
        tail = np.array(end, np.uint32)
        for text, form in zip(texts, forms, strict=True):
            if form == UNCUT:
                own = self.whole(text)
            else:
                first = at[form]
                at[form] += next(counts[form])
                own = flat[cuts[first] : cuts[at[form]]]
            out += [own, tail]
            sizes.append(len(own) + len(tail))
        self.turn()
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array(sizes, np.int64)

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """Ids of each text and `end`, as little-endian 32-bit integers."""
        flat, sizes = self.encode_flat(texts, np.frombuffer(end, "<u4").tolist())
        return [row.astype("<u4").tobytes() for row in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _together(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of GROUP_BYTES or little more, as chunks that repeat in a batch are looked up once."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch[text].nbytes
        if size >= GROUP_BYTES:
            yield pa.concat_batches(some)
            some, size = [], 0
    if some:
        yield pa.concat_batches(some)


WRITTEN = "doc_id bigint, part int, start bigint, n_tokens bigint, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, append `end_id`, and write ORC files in ascending order of the ids.

    Columns: doc_id, part (number of the file's task, ascending with doc_id), start (ids before the
    row in its part), n_tokens (with the end id), ids. Null and empty texts have the end id alone.
    Null ids come first; rows with equal ids are ordered by their text's bytes. `tokenizer` is a
    file of the tokenizers library that every task can open; special strings are treated as the
    library does by default. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        before = 0
        for batch in _together(batches, "body"):
            flat, sizes = encoder.encode_flat([t or b"" for t in batch["body"].to_pylist()], [end_id])
            ends = np.cumsum(sizes)
            starts = before + ends - sizes
            before += int(sizes.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["part"], pa.array(starts), pa.array(sizes), lists], ["doc_id", "part", "start", "n_tokens", "ids"]
            )

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), utf8(text).alias("body"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(encode, WRITTEN).write.options(**{
        "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.row.index.stride": str(ROW_GROUP),
        "orc.stripe.size": str(STRIPE_BYTES),
    }).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids), with start counted over all files.

    The driver holds one sum per file.
    """
    files = spark.read.schema(WRITTEN).orc(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    shifts, seen = [], 0
    for r in sizes:
        shifts.append((r["part"], seen))
        seen += r["n"]
    shift = spark.createDataFrame(shifts, "part int, shift bigint")
    placed = files.join(F.broadcast(shift), "part")  # one row per file
    return placed.select("doc_id", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "ids")


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document; the filter reaches the files' indexes and Bloom filters."""
    return spark.read.schema(WRITTEN).orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "ids")


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of a list of ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values = np.asarray(lists.values).astype("<u4")
            at = np.asarray(lists.offsets)
            yield pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())

    return F.arrow_udf(run, "bigint")(ids)
