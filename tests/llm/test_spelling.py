"""Spelling variants against plain loops."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n string"


def one_edit(a, b):
    """Whether one code point put in, left out or replaced turns a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return sorted(out)


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)
    got = spelling.spelling_variants(df.repartition(4)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in got)


def varied(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    docs = []
    for key in range(n):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = base[min(int(rng.expovariate(0.3)), 24)]
            if rng.random() < 0.2:
                i, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:i] + rng.choice(["", "a", "é"])[: 1 if kind else 0] + w[i + (kind != 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((key, rng.choice([" ", ", ", "1"]).join(words)))
    return docs


@pytest.mark.parametrize("block", [2048, 8])
def test_by_brute_force(spark, monkeypatch, block):
    """With small blocks, most groups are dealt over several."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = [*varied(block), (1000, "xyzxyz " * 130 + "xyzxyyz " * 25 + "xyzxyyzz " * 5)]
    want = brute(docs)
    assert run(spark, docs) == want and any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])


def test_odd_rows(spark):
    long = "q" * 30_000
    docs = [(1, None), (2, ""), (None, "letter letter letter letters"), (None, "letter letter " * 40), (3, "letters " * 8),
            (3, "letters ×÷ßÿÀÖ " * 3), (4, " ".join([long, long + "x", long[:-1]] * 6)), (5, "a b c d e f")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_slips_are_applied(spark):
    docs = [(i, "documents " * 3) for i in range(2000)]
    got = run(spark, docs)
    assert got == brute(docs) and len(got) > 1


def test_index_holds_every_edit():
    words = ["abcdef", "abcdeg", "bbcdef", "abcdfe", "zzzzzz"] * 20
    index = spelling.PositionIndex(spelling._code_points(words, 6))
    q, w = index.replaced(spelling._code_points(["abcdef", "zzzzzy"], 6))
    assert sorted(zip(q.tolist(), w.tolist())) == [(i, j) for i, x in enumerate(["abcdef", "zzzzzy"]) for j, y in enumerate(words) if one_edit(x, y)]
    longer = ["abcdeff", "xabcdef", "abcxdef", "zzzzzzz", "abccdef", "abcdefgh"[:7]]
    q, w = index.shortened(spelling._code_points(longer, 7))
    assert sorted(zip(q.tolist(), w.tolist())) == [(i, j) for i, x in enumerate(longer) for j, y in enumerate(words) if one_edit(x, y)]
    assert np.array_equal(index.having(9, np.array([97])), np.zeros((1, index.width), np.uint64))


def test_counts_are_combined_before_the_shuffle(spark):
    docs = spark.createDataFrame([(1, "letter")], "doc_id bigint, text string")
    plan = spelling.word_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan


def test_hot_group_is_dealt_out(spark, monkeypatch):
    """No task gets more words of a group than two blocks hold."""
    monkeypatch.setattr(spelling, "BLOCK", 16)
    words = spark.range(400).select(F.concat(F.lit("samehead"), F.lpad(F.conv("id", 10, 26), 8, "x")).alias("word"), F.lit(7).alias("n"))
    plan = spelling.near_words(words)
    seen = plan.count()
    rows = [r[0] for r in words.select("word").collect()]
    assert seen == sum(any(one_edit(a, b) for b in rows) for a in rows)
