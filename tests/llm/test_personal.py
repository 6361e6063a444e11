"""Personal data: the patterns as plain regular expressions, and message passing as plain loops."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtide.llm import personal, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    def valid(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and check_digit(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PIECES = ["a", "B9", "@", ".", "..", "x@y.zz", "1.2.3.4", ".5", "256.1.1.1", "007.1.1.01", "4111111111111111", "4111-1111-1111-1111",
          " ", "-", "+1 (017) 555-7713", "+", "9", "٣", "é", " ", "%", "_", "(", ")", "\n", "𝟗", "+44 20 7946 0958"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_patterns(text):
    assert personal.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a.b-" * 100_000 + "@", "+1 " + "(" * 400_000, "1 " * 200_000,
                                  "a@" * 200_000, "x1" * 200_000])
def test_long_texts_take_linear_time(text):
    """A backtracking search would not end."""
    personal.base_spans(text)
    personal.NOTHING.added_spans([personal.make_graph(text)])


def loops(model, graph):
    """Message passing, message by message."""
    score = [[sum(model.unary[f][y] for f in fs) for y in range(personal.LABELS)] for fs in graph.features]
    directed = [(a, b, t, False) for a, b, t in graph.edges] + [(b, a, t, True) for a, b, t in graph.edges]
    message = {(a, b, t): [0.0] * personal.LABELS for a, b, t, _ in directed}
    for _ in range(personal.ROUNDS):
        total = [[score[i][y] + sum(m[y] for (_, b, _), m in message.items() if b == i) for y in range(personal.LABELS)] for i in range(len(score))]
        new, change = {}, 0.0
        for a, b, t, turned in directed:
            out = []
            for y in range(personal.LABELS):
                terms = [total[a][x] - message[b, a, t][x] + (model.pairs[t][y][x] if turned else model.pairs[t][x][y]) for x in range(personal.LABELS)]
                out.append(max(terms) + math.log(sum(math.exp(v - max(terms)) for v in terms)))
            out = [v - max(out) for v in out]
            new[a, b, t] = [personal.DAMPING * o + (1 - personal.DAMPING) * v for o, v in zip(message[a, b, t], out)]
            change = max([change, *[abs(o - v) for o, v in zip(message[a, b, t], new[a, b, t])]])
        message = new
        if change <= personal.SETTLED:
            break
    out = []
    for i in range(len(score)):
        total = [score[i][y] + sum(m[y] for (_, b, _), m in message.items() if b == i) for y in range(personal.LABELS)]
        weight = [math.exp(v - max(total)) for v in total]
        out.append([w / sum(weight) for w in weight])
    return out


def random_model(seed):
    rng = np.random.default_rng(seed)
    return personal.SkipChain(rng.normal(0, 0.5, (personal.N_FEATURES, personal.LABELS)), rng.normal(0, 0.7, (2, personal.LABELS, personal.LABELS)))


TEXTS = ["12 13 14 word 12 then 13, 14 (12)", "9 word 10 11", "", "5", "a@b 1 a@c 1 a@b 1", "7 8 7 8 7 8"]


def test_messages_as_plain_loops():
    model, graphs = random_model(1), [personal.make_graph(t) for t in TEXTS]
    sizes = [len(g.places) for g in graphs]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.asarray([(a + o, b + o, t) for g, o in zip(graphs, offset) for a, b, t in g.edges]).reshape(-1, 3)
    together = model.beliefs(model.scores([f for g in graphs for f in g.features]), edges, np.repeat(np.arange(len(graphs)), sizes))
    alone = [row for g in graphs for row in loops(model, g)]
    assert np.allclose(together, np.asarray(alone), atol=1e-9)


def test_exact_on_trees():
    """Without cycles the probabilities are those of the whole distribution."""
    model, graph = random_model(2), personal.make_graph("12 13 word 14 word 12 15")
    assert [t for _, _, t in graph.edges] == [0, 1, 0]
    small = [0, 1, 4, 7]  # labels looked at
    cut = personal.SkipChain(model.unary[:, small], model.pairs[:, small][:, :, small])
    scores = cut.scores(graph.features)
    want = np.zeros((5, 4))
    for labels in itertools.product(range(4), repeat=5):
        w = math.exp(sum(scores[i][y] for i, y in enumerate(labels)) + sum(cut.pairs[t][labels[a]][labels[b]] for a, b, t in graph.edges))
        want[range(5), labels] += w
    wide = np.zeros((personal.N_FEATURES, personal.LABELS))
    wide[:, small] = cut.unary
    pairs = np.full((2, personal.LABELS, personal.LABELS), -200.0)
    pairs[np.ix_([0, 1], small, small)] = cut.pairs
    wide[0, [y for y in range(personal.LABELS) if y not in small]] = -200.0
    full = personal.SkipChain(wide, pairs)
    got = full.beliefs(full.scores(graph.features), np.asarray(graph.edges), np.zeros(5, np.int64))
    assert np.allclose(got[:, small], want / want.sum(axis=1, keepdims=True), atol=2e-3)


SCHEMA = "doc_id bigint, text string, spans int, base string"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return personal.train(docs)


def found(spark, model, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    out = personal.find_personal_data(df.repartition(2), model).orderBy("doc_id").collect()
    return [([tuple(s) for s in r["personal"]["base"]], [tuple(s) for s in r["personal"]["spans"]]) for r in out]


def test_spans_are_added(spark, model):
    two = "word 7536784127813050 4845168114407329 word"
    again = "call +1 (132) 555-1352 now, later more words, then +1 (132) 555-1352 43.21.141.162 here"
    clean = "In 2024 there were 17 of 20 words, 3.5 of them new; see 4.2 and 1,000 more."
    odd = [None, "", "no digits at all", "@ @@ +", "x" * 100_000 + " 1"]
    rows = found(spark, model, [two, again, clean, *odd])
    assert rows[0] == ([], [("card", 5, 21), ("card", 22, 38)])
    base, spans = rows[1]
    assert base == brute(again) and ("phone", 51, 68) in spans and set(base) < set(spans)
    assert rows[2] == ([], [])
    assert all(r == ([], []) for r in rows[3:])


def test_edges_carry_labels(model):
    """A token that says nothing by itself takes the label of its equal: skip edges speak for agreement."""
    for kind in (2, 3):
        label = 2 * kind + 1
        assert model.pairs[1, label, label] > model.pairs[1, label, 0] and model.pairs[1, label, label] > model.pairs[1, 0, label]


def test_base_of_a_table(spark, data):
    rows = {r["doc_id"]: r for r in queries.op13_personal_data(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        own, r = brute(d["text"]), rows[d["doc_id"]]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(o[0] == k for o in own) for k in personal.KINDS]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert personal.train(docs) is personal.NOTHING
    assert personal.find_personal_data(docs, personal.NOTHING).count() == 0


def test_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "mail a.b@c.de", 1, "x")] * 3 + [(1, None, 1, "x"), (1, "1 " * 300, 1, "x")], SCHEMA)
    out = personal.find_personal_data(docs, personal.train(docs)).select("personal.*").collect()
    assert sorted(len(r["base"]) for r in out) == [0, 0, 1, 1, 1]


def test_masked(spark):
    text = "é mail a.b@c.de, then 4111111111111111."
    df = spark.createDataFrame([(1, text, 1, "x"), (2, None, 1, "x"), (3, "plain", 1, "x")], SCHEMA)
    out = personal.find_personal_data(df, personal.NOTHING).orderBy("doc_id")
    assert [r[0] for r in out.select(personal.masked(F.col("text"), F.col("personal.spans"))).collect()] == [
        "é mail <email>, then <card>.", None, "plain"]
