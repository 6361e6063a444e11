"""Benchmark windows against a direct search."""

import hashlib
import random
import re
import time

import pytest

from voxtide.llm.decontaminate import Windows, find_passages, judge, remove_documents, remove_spans

DOCS = "doc_id bigint, text string, items string, hit int"
ITEMS = "item_id bigint, text string, starts int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items, size=13):
    own, hit, found = words(doc), set(), set()
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(docs)], DOCS),
        spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS),
    )


def case():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(n))
    items = [(i, text(30)) for i in range(8)] + [(90, "Short, ITEM é"), (91, "one"), (92, ""), (93, None), (None, text(20)), (7, text(15))]
    items += [items[0]]
    docs = [None, "", "!!", "short item É short item é", "ONE", text(400)]
    for i, t in items[:6]:
        docs.append(f"{text(20)} {t.upper()}. {text(300 * (i % 2))}")
    docs.append(f"x {items[12][1]} y")
    docs += [docs[-1], text(12), "z " * 5000 + items[1][1]]
    return docs, items


def test_windows(spark):
    docs, items = case()
    got = {r["doc_id"]: tuple(r)[1:] for r in judge(*tables(spark, docs, items)).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(docs)}


def test_slices_change_nothing(spark):
    docs, items = case()
    whole, sliced = judge(*tables(spark, docs, items)), judge(*tables(spark, docs, items), slice_bytes=150)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.collect()))


def test_equal_hashes_are_compared(monkeypatch):
    from voxtide.llm import decontaminate

    monkeypatch.setattr(decontaminate, "_hashes", lambda columns: columns[0].astype("u8") * 0)
    made = Windows([("1", b"a b c"), ("2", b"c b a")], 2)
    assert made.scan([b"b", b"a", b"b"]) == ([(0, 2), (1, 3)], {"1", "2"})
    assert made.scan([b"a", b"c", b"a"]) == ([], set())


def test_removal(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [f"Before, {passage.upper()}! After.", "clean text", None, passage, f"{'x ' * 2000}{passage}"]
    d, b = tables(spark, docs, [(1, passage)])
    cut = {r["doc_id"]: r["text"] for r in remove_spans(d, b).collect()}
    assert cut == {0: "Before, ! After.", 1: "clean text", 2: None, 3: "", 4: "x " * 2000}
    left = remove_documents(d, b)
    assert left.columns == d.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4]  # a hundredth of the last one is hit


def test_empty_tables(spark):
    d, b = tables(spark, ["a b"], [(1, "a b")])
    none = judge(d, b.limit(0)).collect()
    assert [tuple(r)[1:4] for r in none] == [(2, 0, 0)]
    assert judge(d.limit(0), b).count() == 0
    with pytest.raises(ValueError):
        find_passages(d, b, column="text")


def test_equal_windows_of_many_items_are_kept_once():
    text = " ".join(f"w{i}" for i in range(40))
    items = [(str(i), text.encode()) for i in range(2000)] + [("other", b"x " + text.encode()), (None, text.encode())]
    made = Windows(items)
    hashes, _, begin, listed = made.lengths[13]
    assert len(hashes) == 29 and len(listed) == 28 * 2002 + 1 and begin[-1] == len(listed)
    spans, found = made.scan([b"foreign", *text.encode().split()] * 3)
    assert len(spans) == 28 * 3 and found == {str(i) for i in range(2000)} | {"other"}


def test_one_window_in_fifty_thousand_items():
    """A text of 400 hits, one verification for each; the items are listed once."""
    text = " ".join(f"w{i % 13}" for i in range(412))
    made = Windows([(str(i), b" ".join(b"w%d" % j for j in range(13))) for i in range(50_000)])
    assert [len(a) for a in made.lengths[13]] == [1, 1, 2, 50_000]
    began = time.process_time()
    spans, found = made.scan(text.encode().split())
    assert len(spans) == 31 and spans[:2] == [(0, 13), (13, 26)] and len(found) == 50_000
    assert time.process_time() - began < 1


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3)], "doc_id bigint, text string, hits int, _hits_0 int, HITS_ int")
    bench = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "x")], "item_id bigint, text string")
    assert remove_documents(docs, bench).count() == 0 and remove_spans(docs, bench).columns == docs.columns
    assert judge(docs, bench, keep=["doc_id", "hits"]).first()["n_items"] == 2
    sliced = find_passages(docs, bench, column="found", slice_bytes=2)
    assert sliced.columns == [*docs.columns, "found"] and sliced.first()["_hits_0"] == 2
    with pytest.raises(ValueError):
        judge(docs, bench, keep=["doc_id", "N_hit"])
