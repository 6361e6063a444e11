"""Near-duplicate groups against all pairs."""

import random
import re

import numpy as np

from voxtide.llm import near_dup
from voxtide.llm.near_dup import block_links, keep_one, near_duplicates, shingle_sets, signatures

SCHEMA = "doc_id bigint, text string, id string, u int, v int, component_id int, n int"


def shingle_set(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=4):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= 80 * len(a | b):
                a_, b_ = root(i), root(j)
                up[max(a_, b_)] = min(a_, b_)
    return sorted(
        ((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str
    )


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(df, **options).collect()), key=str)


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def test_same_as_all_pairs(spark):
    rng = random.Random(3)
    rows, shared = [], [f"s{i}" for i in range(60)]
    for f in range(12):
        base = [f"w{f}x{i}" for i in range(rng.choice([20, 60, 150]))] + (shared if f % 3 == 0 else [])
        for _ in range(14):
            rows.append((len(rows), family(rng, base, rng.randrange(7))))
    assert run(spark, rows) == brute(rows)
    rows += [(-1, "a b c d"), (-2, "A b c d "), (-3, "a b c d e")]  # four words are a whole text at five a shingle
    five = run(spark, rows, shingle=5)
    assert five == brute(rows, 5) and five != run(spark, rows)


def test_members_that_only_other_members_link(spark):
    """The first member of a bucket is similar to none; the others are similar to each other."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(100)]
    rows = [(0, " ".join(common))]
    for f in range(4):
        own = common[:75] + [f"f{f}x{i}" for i in range(25)]
        rows += [(len(rows) + k, family(rng, own, 1)) for k in range(40)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A  B\nC"), (8, "a b c d"), (9, "a b c d"),
            (9, "a b c d"), (None, "a b c d"), (10, long), (11, long + " x"), (12, "É b"), (13, "é b"), (14, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d e", "x", 1, 2, 3, 4), (1, "a b c d e", "y", 1, 2, 3, 4), (2, None, "z", 1, 2, 3, 4)], SCHEMA)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_repeated_rows_stay_once(spark):
    text = "one two three four five six seven"
    rows = [(1, text, {"a": 1}, 5), (1, text, {"a": 2}, 6), (1, "quite another text with other words", None, 1), (2, text, None, 2),
            (None, text, None, 3), (None, text, None, 3), (3, None, None, 4), (3, None, None, 4), (4, "", None, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>, rank int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == [(0, text), (0, text), (1, text), (1, rows[2][1]), (3, ""), (4, "")]
    assert sorted(map(str, kept.collect())) == sorted(map(str, keep_one(df.repartition(5)).collect()))


def test_signatures_estimate_similarity():
    """Shared minima and maxima are as frequent as the similarity says."""
    rng = random.Random(6)
    common = [f"c{i}".encode() for i in range(400)]
    a, b = shingle_sets([b" ".join(common + [b"%s%d" % (x, rng.randrange(10**9)) for _ in range(40)]) for x in (b"a", b"b")])
    similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    bands = signatures([a, b])
    shared = (bands[0] == bands[1]).mean()
    assert abs(shared - similarity**4) < 0.2


def test_recall_bound():
    """A pair at the least similarity shares no band with a probability below 1e-7."""
    assert (1 - 0.8 ** (2 * near_dup.PER_BAND)) ** near_dup.BANDS < 1e-7


def test_block_links_between_sides():
    sets = [np.arange(0, 10, dtype=np.uint64), np.arange(0, 9, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)]
    ids, own = np.array([4, 5, 6, 7]), np.array([4, 5, 6, 7])
    assert block_links(ids, own, np.array([0, 1, 0, 1]), sets, 80) == [(4, 5), (4, 7)]
    assert block_links(ids, own, np.array([0, 0, 0, 0]), sets, 80) == [(4, 5), (4, 7)]
    assert block_links(ids, np.array([4, 4, 6, 4]), np.array([0, 0, 0, 0]), sets, 80) == []
