"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field that adds to them.

The patterns (email, ip, card, phone) give the base spans, which always stay. Every token with a digit
or an @ is a node of a graph per document and has one of nine labels: outside, or first or later
token of one of the four kinds. Neighbouring tokens are joined by chain edges, tokens that are equal
or similar (the same text, the same seven or more digits, the same name before the @) by skip
edges from each occurrence to the next one, however far. Loopy message passing makes equal tokens
agree: what is recognised in one place helps in places that the patterns do not cover. Tokens without
digit and @ are outside, and count as context of their neighbours.

The field is trained here by pseudo-likelihood on a bounded sample of documents, with the base spans as
labels. Failing matches that run over several tokens (two cards side by side, say) are unknown and not
learned from. Half of the training nodes come once more without their own features,
so that the edges learn to speak for tokens that say nothing themselves.

What is defined for odd rows: a null text is an empty one, and both have no spans. Places are code
points. Texts of any length are looked at as a whole; every step is linear in the length. Rows that
repeat an id are texts of their own. Without a document to learn from, the base spans are the result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import batch_udf, small_batches, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # 0: outside, 2k + 1: first token of kind k, 2k + 2: a later one
SAMPLE = 2_000  # documents learned from
SAMPLE_TOKENS = 100  # nodes of a document that is learned from; documents with more are not
STEPS, RATE, PENALTY = 200, 0.1, 1e-4
DAMPING, SETTLED, ROUNDS = 0.3, 1e-3, 200
SURE = 0.5  # mean probability of the labels of an added span
CUES, SHAPES = 64, 256  # buckets of words before a token, and of token shapes
N_FEATURES = 64 + CUES + SHAPES

SPAN = "struct<kind:string,start:bigint,end:bigint>"
SCHEMA = f"base array<{SPAN}>, spans array<{SPAN}>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SHAPE = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[A-Za-z]+"), "a"), (re.compile(r"[^\x00-\x7F]+"), "u")]


def luhn(digits: str) -> bool:
    """Whether the last of the digits is the check digit of the others."""
    own = [int(d) for d in digits]
    twice = [2 * d - 9 * (d > 4) for d in own[-2::-2]]
    return (sum(own[-1::-2]) + sum(twice)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is all that may stand before an @ (after the last match), so each @ is looked at once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = max(done, text.rfind("@", done, at) + 1)
        start = at - len(_LOCAL.match(text[before:at][::-1]).group())
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, cut into fours from their start."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        place = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = place + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield place, end
            place = end + 1


def _scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (kind, start, end) in order, and places whose kind is unknown."""
    spans, unknown = [], []
    if "@" in text:
        spans += [(0, s, e) for s, e in _emails(text)]
    spans += [(1, s, e) for s, e in _addresses(text)]
    for m in _DIGITS.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
        elif len(digits) >= 16 and " " in m.group():  # perhaps several numbers
            unknown.append((m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = len(_NOT_DIGIT.sub("", m.group()))
            if 8 <= n <= 15:
                spans.append((3, m.start(), m.end()))
            elif n > 15:
                unknown.append((m.start(), m.end()))
    return spans, unknown


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the patterns find, by kind, then place."""
    return [(KINDS[k], s, e) for k, s, e in _scan(text or "")[0]]


@dataclass
class Graph:
    """Nodes and edges of one document."""

    places: list[tuple[int, int]]  # start and end of each node's token without what surrounds it
    features: list[list[int]]
    edges: list[tuple[int, int, int]]  # earlier node, later node, 0: chain, 1: skip


def _core(token: str) -> tuple[int, int]:
    """Start and end of a token without punctuation around it; a leading + and parentheses belong to it."""
    start, end = 0, len(token)
    while start < end and not (token[start].isalnum() or token[start] in "+("):
        start += 1
    while end > start and not (token[end - 1].isalnum() or token[end - 1] == ")"):
        end -= 1
    return start, end


def _features(core: str, digits: str, before: str | None, before_is_node: bool, after_is_node: bool) -> list[int]:
    groups = [g for g in _NOT_DIGIT.split(core) if g]
    dotted = core.split(".")
    shape = core
    for pattern, sign in _SHAPE:
        shape = pattern.sub(sign, shape)
    ascii_letters = any("a" <= c <= "z" or "A" <= c <= "Z" for c in core)
    facts = [
        ("@" in core), core.startswith("+"), "(" in core or ")" in core, "-" in core, ascii_letters, not core.isascii(),
        16 <= len(digits) <= 19 and len(digits) + core.count("-") == len(core) and luhn(digits),
        len(dotted) == 4 and all(g.isascii() and g.isdigit() and len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in dotted),
        before is None, before_is_node, after_is_node,
    ]
    out = [0]  # the bias
    out += [1 + i for i, fact in enumerate(facts) if fact]
    out.append(13 + min(len(digits), 24))
    out.append(38 + min(len(groups), 6))
    out.append(45 + min(max(map(len, groups), default=0), 8))
    out.append(54 + min(len(dotted), 5))
    if before is not None and not before_is_node:
        out.append(64 + zlib.crc32(before.encode("utf-8", "surrogatepass")) % CUES)
    out.append(64 + CUES + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES)
    return out


def make_graph(text: str) -> Graph:
    """The nodes of a text, their features, and the edges between them."""
    places, features, edges = [], [], []
    last: dict[tuple[str, str], int] = {}
    previous, previous_node = None, False  # the token before, and whether it is a node
    tokens = list(_TOKEN.finditer(text))
    is_node = [_ANY.search(m.group()) is not None for m in tokens]
    for i, m in enumerate(tokens):
        if is_node[i]:
            token = m.group()
            start, end = _core(token)
            core = token[start:end] or token
            digits = _NOT_DIGIT.sub("", core)
            node = len(places)
            places.append((m.start() + start, m.start() + end) if end > start else m.span())
            features.append(_features(core, digits, previous, previous_node, i + 1 < len(tokens) and is_node[i + 1]))
            if previous_node:
                edges.append((node - 1, node, 0))
            keys = [("text", core.lower())]
            if len(digits) >= 7:
                keys.append(("digits", digits))
            if "@" in core:
                keys.append(("name", core.split("@")[0].lower()))
            for other in sorted({last[k] for k in keys if k in last}):
                edges.append((other, node, 1))
            last.update(dict.fromkeys(keys, node))
            previous, previous_node = token, True
        else:
            previous, previous_node = m.group(), False
    return Graph(places, features, edges)


def _silver(graph: Graph, spans: list[tuple[int, int, int]], unknown: list[tuple[int, int]]) -> list[int]:
    """Labels of the nodes by the base spans; -1 where the kind is unknown. All lists are in order of place."""
    marks = sorted([(s, e, k) for k, s, e in spans] + [(s, e, -1) for s, e in unknown], key=lambda m: (m[2] < 0, m[0]))
    out = [0] * len(graph.places)
    starts = np.asarray([s for s, _ in graph.places])
    ends = np.asarray([e for _, e in graph.places])
    for s, e, k in marks:
        for n, node in enumerate(range(int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left")))):
            if out[node] == 0:
                out[node] = -1 if k < 0 else 2 * k + 1 + (n > 0)
    return out


def log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(axis=-2, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=-2)) + most[..., 0, :]


@dataclass(frozen=True)
class SkipChain:
    """Log potentials: features by label, and chain and skip edges by the labels of both ends."""

    unary: np.ndarray
    pairs: np.ndarray  # (2, LABELS, LABELS): earlier label, later label

    def scores(self, features: list[list[int]]) -> np.ndarray:
        sizes = [len(f) for f in features]
        flat = np.fromiter((i for f in features for i in f), np.int64, sum(sizes))
        return np.add.reduceat(self.unary[flat], np.cumsum([0, *sizes[:-1]]), axis=0) if sizes else np.zeros((0, LABELS))

    def beliefs(self, scores: np.ndarray, edges: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Probabilities of the labels of all nodes, by loopy message passing.

        `owner` numbers the documents of the nodes. A document is done when its largest change of a
        message is small, whatever other documents are in the batch, or after ROUNDS rounds.
        """
        n = len(edges)
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        potential = np.concatenate([self.pairs[edges[:, 2]], self.pairs[edges[:, 2]].transpose(0, 2, 1)])
        message = np.zeros((2 * n, LABELS))
        total = scores.copy()  # with all messages to a node added
        document = owner[source]
        going = np.arange(2 * n)
        for _ in range(ROUNDS):
            if not len(going):
                break
            back = np.where(going < n, going + n, going - n)
            new = log_sum((total[source[going]] - message[back])[:, :, None] + potential[going])
            new -= new.max(axis=1, keepdims=True)
            new = DAMPING * message[going] + (1 - DAMPING) * new
            change = np.abs(new - message[going]).max(axis=1)
            message[going] = new
            total = scores.copy()
            np.add.at(total, target, message)
            unsettled = np.zeros(int(owner.max(initial=-1)) + 1, bool)
            unsettled[document[going[change > SETTLED]]] = True
            going = going[unsettled[document[going]]]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added_spans(self, graphs: list[Graph]) -> list[list[tuple[int, int, int]]]:
        """Spans (kind, start, end) of the most probable labels of each graph."""
        sizes = [len(g.places) for g in graphs]
        offset = np.concatenate([[0], np.cumsum(sizes)])
        edges = [(a + o, b + o, t) for g, o in zip(graphs, offset.tolist()) for a, b, t in g.edges]
        scores = self.scores([f for g in graphs for f in g.features])
        p = self.beliefs(scores, np.asarray(edges, np.int64).reshape(-1, 3), np.repeat(np.arange(len(graphs)), sizes))
        label, sure = p.argmax(axis=1), p.max(axis=1)
        out = []
        for g, o in zip(graphs, offset.tolist()):
            chained = {b for a, b, t in g.edges if t == 0}
            runs: list[tuple[int, list[int]]] = []
            before = 0  # label of the node before
            for node in range(len(g.places)):
                own = int(label[o + node])
                kind = (own - 1) // 2
                if own and own % 2 == 0 and before and (before - 1) // 2 == kind and node in chained:
                    runs[-1][1].append(node)
                elif own:
                    runs.append((kind, [node]))
                before = own
            out.append([
                (kind, g.places[nodes[0]][0], g.places[nodes[-1]][1]) for kind, nodes in runs
                if sure[[o + x for x in nodes]].mean() >= SURE
            ])
        return out


NOTHING = SkipChain(np.zeros((N_FEATURES, LABELS)), np.zeros((2, LABELS, LABELS)))  # most probable everywhere: outside


def fit(rows: list[tuple[list[list[int]], list[int], list[tuple[int, int, int]]]]) -> SkipChain:
    """Fit the field to (features, labels, edges) of documents by pseudo-likelihood.

    Each node is predicted from its features and the labels of its neighbours: a concave problem,
    solved by a fixed number of steps from zero.
    """
    nodes = [(f, y, d) for d, (fs, ys, _) in enumerate(rows) for f, y in zip(fs, ys, strict=True)]
    label = np.asarray([y for _, y, _ in nodes], np.int64)
    offset = np.cumsum([0, *[len(ys) for _, ys, _ in rows]])
    edges = np.asarray([(a + o, b + o, t) for (_, _, es), o in zip(rows, offset.tolist(), strict=False) for a, b, t in es], np.int64).reshape(-1, 3)
    edges = edges[(label[edges[:, 0]] >= 0) & (label[edges[:, 1]] >= 0)]
    x = np.zeros((len(nodes), N_FEATURES), np.float32)
    for i, (f, _, _) in enumerate(nodes):
        x[i, f] = 1
    blank = np.flatnonzero(np.arange(len(nodes)) % 2 == 0)  # once more, with the bias only
    y = np.concatenate([label, label[blank]])
    x = np.concatenate([x, np.eye(1, N_FEATURES, dtype=np.float32).repeat(len(blank), axis=0)])
    # labels of earlier and later neighbours, by kind of edge
    around = np.zeros((4, len(nodes), LABELS), np.float32)
    for t in (0, 1):
        some = edges[edges[:, 2] == t]
        np.add.at(around[2 * t], (some[:, 1], label[some[:, 0]]), 1)
        np.add.at(around[2 * t + 1], (some[:, 0], label[some[:, 1]]), 1)
    around = np.concatenate([around, around[:, blank]], axis=1)
    kept = y >= 0
    x, y, around = x[kept], y[kept], around[:, kept]
    if not len(y):
        return NOTHING
    truth = np.eye(LABELS, dtype=np.float32)[y]
    weights = np.zeros((N_FEATURES + 2 * LABELS, LABELS))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        unary, pairs = weights[:N_FEATURES], weights[N_FEATURES:].reshape(2, LABELS, LABELS)
        score = x @ unary.astype(np.float32)
        for t in (0, 1):
            score = score + around[2 * t] @ pairs[t].astype(np.float32) + around[2 * t + 1] @ pairs[t].T.astype(np.float32)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        gap = truth - p / p.sum(axis=1, keepdims=True)
        slope = [x.T @ gap, *[around[2 * t].T @ gap + (around[2 * t + 1].T @ gap).T for t in (0, 1)]]
        slope = np.concatenate(slope).astype(np.float64) / len(y) - PENALTY * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        weights = weights + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return SkipChain(weights[:N_FEATURES], weights[N_FEATURES:].reshape(2, LABELS, LABELS))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> SkipChain:
    """Fit the field on the SAMPLE documents of smallest hash that have a digit or an @.

    Documents are chosen by the hash of id and text alone; only those chosen are cut into tokens. The
    driver receives feature numbers, labels and edges of at most SAMPLE documents of at most
    SAMPLE_TOKENS nodes. Rows equal in id and text count as one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"), F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
    chosen = rows.select("h").distinct().orderBy("h").limit(SAMPLE)
    sample = rows.join(F.broadcast(chosen), "h", "left_semi")  # at most SAMPLE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, t in zip(batch["h"].to_pylist(), batch["t"].to_pylist(), strict=True):
                graph = make_graph(t)
                if 0 < len(graph.places) <= SAMPLE_TOKENS:
                    out.append((h, graph.features, _silver(graph, *_scan(t)), [list(e) for e in graph.edges]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "f", "y", "e"])

    parts = sample.mapInArrow(run, "h bigint, f array<array<int>>, y array<int>, e array<array<int>>")
    found = parts.groupBy("h").agg(F.first("f").alias("f"), F.first("y").alias("y"), F.first("e").alias("e")).orderBy("h").toArrow()
    return fit([(r["f"], r["y"], [tuple(e) for e in r["e"]]) for r in found.to_pylist()])


def _apart(added: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The added spans that touch no base span."""
    if not added or not base:
        return added
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    ends = np.maximum.accumulate([e for _, e in taken])
    before = [bisect_left(starts, e) for _, _, e in added]  # base spans that start before this one ends
    return [span for span, i in zip(added, before, strict=True) if i == 0 or ends[i - 1] <= span[1]]


def find_personal_data(docs: DataFrame, model: SkipChain, text: str = "text", column: str = "personal") -> DataFrame:
    """Add a struct of `base` and `spans`: (kind, start, end) of the base spans, and of all spans.

    Both are ordered by kind (as in KINDS), then place. An added span that touches a base span is
    left out. A column of the name of `column` is replaced.
    """
    small_batches(docs.sparkSession)

    def work(texts: list[bytes | None]) -> pa.Array:
        graphs, base = [], []
        for raw in texts:
            t = "" if raw is None else raw.decode()
            some = _ANY.search(t) is not None
            base.append(_scan(t)[0] if some else [])
            graphs.append(make_graph(t) if some else Graph([], [], []))
        out = []
        for own, added in zip(base, model.added_spans(graphs), strict=True):
            out.append(sorted([*own, *_apart(added, own)]))
        named = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row] for row in rows] for rows in (base, out)]
        return pa.StructArray.from_arrays([pa.array(rows, SPAN_TYPE) for rows in named], names=["base", "spans"])

    return docs.withColumn(column, batch_udf(work, SCHEMA)(utf8(text)))


def span_list(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap the first one counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        after = F.struct(F.concat(state["out"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= state["at"], after).otherwise(state)

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.char_length(text)))

    return F.aggregate(ordered, start, step, finish)
