"""Token counts, token files and segmentations against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxtide.llm import queries
from voxtide.llm.nbest import Lattice, Segmenter, decode_ids, encode_n_best
from voxtide.llm.orc_ids import Encoder, ids_crc32, read_document, read_token_ids, write_token_ids
from voxtide.llm.pieces import Vocabulary, chunks, symbols
from voxtide.llm.token_count import Merger, count_tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, n_tokens string, ids int, start int, body int, part int"
BITS = [" ", "  ", "\n", "\n\n", "a", "the", "\t", "é", "日", "🙂", "==", "=", "0", "12", "\r", "ing", "x", "\x00", "'s", '"', " \n", "ꙮ",
        " ", " ", "\x1c", "　", "<|endoftext|>", "<s>", ".", ",", "\x0b"]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def merger():
    return Merger(Vocabulary.load(PIECES))


@pytest.fixture(scope="module")
def segmenter():
    return Segmenter(PIECES)


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 300 if rng.random() < 0.05 else 15))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


ODD = [(5, None), (1, ""), (2, " "), (3, "a  b \n"), (None, "null id"), (4, "same"), (4, "same"), (6, "=" * 5000), (7, "word " * 50_000)]


def test_merging_in_step(merger, pieces):
    own = texts(3000) + ["=" * 1000, " " * 1000, "ab" * 400, "the" * 300, "▁x ▁"]
    parts = [chunks(t.encode()) for t in own]
    counts = iter(merger.counts([symbols(c) for p in parts for c in p]))
    got = [sum(next(counts) for _ in p) for p in parts]
    assert got == [len(pieces.encode(t)) for t in own]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(merger, pieces, text):
    assert sum(merger.counts([symbols(c) for c in chunks(text.encode())])) == len(pieces.encode(text))


def test_counts_of_the_table(spark, data, pieces):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op6_token_count(spark, data).collect():
        text = rows[r["doc_id"]]["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(pieces.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_counts_of_odd_rows(spark, pieces):
    got = sorted((r[0] or 0, r["n_tokens"]) for r in count_tokens(frame(spark, ODD), PIECES).collect())
    assert got == sorted((i or 0, len(pieces.encode(t or ""))) for i, t in ODD)
    assert count_tokens(frame(spark, []), PIECES).count() == 0


def test_encoder_is_the_library():
    encoder, library = Encoder(BYTES), Tokenizer.from_file(BYTES)
    own = texts(6000, 2)
    got = encoder.encode([t.encode() for t in own], b"")
    for text, ids in zip(own, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_encoder_that_must_not_cut():
    file = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = Encoder(file), Tokenizer.from_file(file)
    assert not encoder.cuts
    for text in ("Hello  World", "", "a\nb"):
        assert np.frombuffer(encoder.encode([text.encode()], b"")[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def expected_file(rows):
    library, at, out = Tokenizer.from_file(BYTES), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_of_the_table(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op7_token_ids_orc(spark, data).collect())) == expected_file(rows)


def test_token_files_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "ids")
    write_token_ids(frame(spark, ODD), path, BYTES)
    got = read_token_ids(spark, path).select("doc_id", "start", "n_tokens", ids_crc32(F.col("ids")))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected_file(ODD)
    found = read_document(spark, path, 6)
    assert found.collect()[0]["ids"][-1] == 0
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)]" in found._jdf.queryExecution().executedPlan().toString()
    empty = str(tmp_path / "none")
    write_token_ids(frame(spark, []), empty, BYTES)
    assert read_token_ids(spark, empty).count() == 0


def test_token_files_carry_indexes(spark, tmp_path):
    import pyarrow.orc

    path = tmp_path / "ids"
    write_token_ids(frame(spark, ODD), str(path), BYTES)
    file = pyarrow.orc.ORCFile(str(next(path.glob("*.orc"))))
    assert file.row_index_stride == 1024 and file.compression == "ZSTD"


def all_paths(lattice: Lattice, text: str):
    out = []

    def go(i, worth, ids):
        if i == len(text):
            out.append((worth, ids))
            return
        for j in range(i + 1, min(len(text), i + lattice.longest) + 1):
            piece = text[i:j]
            if piece in lattice.worth:
                go(j, worth + lattice.worth[piece], ids + [lattice.ids[piece]])
            elif j == i + 1:
                spelled = lattice.spelled(piece)
                go(j, worth + lattice.unknown - len(spelled) + 1, ids + spelled)

    go(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_are_the_best_of_all(segmenter, n):
    rng = random.Random(n)
    some = [" ", "  ", "\n", "a", "the", "\t", "é", "日", "🙂", "==", "0", "ing", "x", "th", "er", "ꙮ"]
    for _ in range(120):
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 5)))
        if len(text) > 11:
            continue
        part = chunks(text.encode())
        segmenter.learn([part])
        got = segmenter.segment(part, n)
        want = all_paths(segmenter.lattice, "▁" + text.replace(" ", "▁"))
        assert [w for w, _ in got] == [w for w, _ in want[:n]]
        worth = {np.array(ids, "<u4").tobytes(): w for w, ids in want}
        assert len({ids for _, ids in got}) == len(got) and all(worth[ids] == w for w, ids in got)


def test_long_chunks_take_the_same_way(segmenter):
    rng = random.Random(8)
    for _ in range(20):
        text = "▁" + "".join(rng.choice("theringa") for _ in range(rng.randint(5, 60)))
        side_by_side = segmenter.lattice.best_two([text])[0]
        (a, ids), (b, _) = segmenter.lattice.n_best(text, 2)
        assert side_by_side == (np.array(ids, "<u4").tobytes(), a, a - b)


def test_segmentation_of_rows(spark, data):
    rows = encode_n_best(frame(spark, ODD), PIECES, n=3).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] for r in rows)
    for r in rows:
        assert r["scores"] == sorted(r["scores"], reverse=True) and len(r["scores"]) == len(r["sizes"]) == len(r["crc32s"])
        assert r["n_pieces"] == len(r["ids"]) == r["sizes"][0]
        assert r["crc32s"][0] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        if r["doc_id"] in (1, 5):
            assert (r["scores"], r["ids"]) == ([0.0], [])
    assert encode_n_best(frame(spark, []), PIECES).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    back = decode_ids(encode_n_best(docs, PIECES), PIECES)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.select("doc_id", "text").collect()))
    strange = spark.createDataFrame([(1, None), (2, [-5, None, 10**6]), (3, [])], "doc_id bigint, ids array<int>")
    assert sorted(map(tuple, decode_ids(strange, PIECES).collect())) == [(1, None), (2, ""), (3, "")]


def test_best_scores_at_least_what_the_library_finds(segmenter, pieces):
    """The library merges greedily; no segmentation of its may score higher than the best path."""
    for text in texts(300, 4):
        if "▁" in text or not text:
            continue
        part = chunks(text.encode())
        segmenter.learn([part])
        best = segmenter.segment(part, 1)[0][0]
        lattice, merged = segmenter.lattice, 0
        for piece in pieces.encode(text, out_type=str):
            merged += lattice.worth.get(piece, lattice.unknown if piece.startswith("<0x") else 0)
        assert best >= merged or "<0x" in "".join(pieces.encode(text, out_type=str))
