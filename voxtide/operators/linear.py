"""Linear classifiers by Newton steps, many at a time.

A problem is one set of weights to find: one class against the others (or all classes at once, for
the softmax loss), one penalty, one loss, with one fold of the rows left out. All problems that are
given together share every pass over the rows: a pass multiplies the rows with the weights of all
problems as one matrix and sums losses, gradients and products with second derivatives on the
executors. So a grid search over folds, penalties, losses and classes costs as many passes as its
slowest problem, not their sum.

The weights of a problem minimise  w·w / 2 + C · Σ weight_i · loss_i ; the intercept is not penalised.
The hinge is made smooth within SMOOTH of its corner, so its optimum is off by at most
C · SMOOTH / 2 per unit of row weight. The driver holds a few numbers per term and problem.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.operators.reduce import CHUNK, densify, packed, sparse_columns, sum_of_matrices, sum_of_packed
from voxtide.session import materialize

LOSSES = ("log", "squared_hinge", "hinge", "softmax")
SMOOTH = 0.1
NEWTON_STEPS, CG_STEPS, HALVINGS = 50, 12, 12


@dataclass(frozen=True)
class Problem:
    """`target` is the class told from the others; the softmax loss tells all classes apart."""

    loss: str
    C: float
    target: int | None = None
    fold: int = -1  # rows of this fold are left out


def labelled_rows(df: DataFrame, label: str, classes: Sequence[str], features: str = "features", fold: str | None = None) -> DataFrame:
    """Rows as the passes read them: `indices`, `values`, `y` (number of the class), `fold`."""
    y = F.array_position(F.lit(list(classes)), F.col(label).cast("string")) - 1
    at = F.lit(-2) if fold is None else F.col(fold)
    rows = df.where(y >= 0).select(features, y.cast("int").alias("y"), at.cast("int").alias("fold"))
    return sparse_columns(rows, features, ["y", "fold"])


ROWS_PER_TASK = 20_000


def written(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder in parts of at most about ROWS_PER_TASK rows, enough for all cores.

    Every pass reads all of them, so an uneven table is dealt out once, before the first one.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    return materialize(rows.repartition(parts), label)


def balanced_weights(rows: DataFrame, n_classes: int, folds: Sequence[int]) -> dict[int, np.ndarray]:
    """For each fold left out: weight n / (k · n_c) of the rows of each class among the rest."""
    counts = rows.groupBy("y", "fold").count().collect()
    out = {}
    for fold in folds:
        kept = np.zeros(n_classes)
        for r in counts:
            kept[r["y"]] += r["count"] if r["fold"] != fold else 0
        out[fold] = np.divide(kept.sum(), kept * np.count_nonzero(kept), out=np.zeros(n_classes), where=kept > 0)
    return out


def _columns(problems: Sequence[Problem], n_classes: int) -> list[slice]:
    out, at = [], 0
    for p in problems:
        n = n_classes if p.loss == "softmax" else 1
        out.append(slice(at, at + n))
        at += n
    return out


def _derivatives(p: Problem, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss per row, slope by score, and diagonal second derivative by score."""
    if p.loss == "softmax":
        most = score.max(axis=1, keepdims=True)
        e = np.exp(score - most)
        total = e.sum(axis=1, keepdims=True)
        share = e / total
        loss = (np.log(total) + most)[:, 0] - score[np.arange(len(y)), y]
        slope = share.copy()
        slope[np.arange(len(y)), y] -= 1
        return loss, slope, share * (1 - share)
    sign = np.where(y == p.target, 1.0, -1.0)[:, None]
    z = sign * score
    if p.loss == "log":
        near = 1 / (1 + np.exp(-np.abs(z)))
        other = np.where(z >= 0, 1 - near, near)  # probability of the wrong side
        return (np.maximum(-z, 0) + np.log1p(np.exp(-np.abs(z))))[:, 0], -sign * other, other * (1 - other)
    gap = np.maximum(1 - z, 0)
    if p.loss == "squared_hinge":
        return (gap * gap)[:, 0], -2 * sign * gap, 2.0 * (gap > 0)
    if p.loss == "hinge":
        inside = gap < SMOOTH
        loss = np.where(inside, gap * gap / (2 * SMOOTH), gap - SMOOTH / 2)
        # before the corner there is no curvature: the parabola that touches the loss here and at its corner has this one
        return loss[:, 0], -sign * np.minimum(gap / SMOOTH, 1), (gap > 0) * 0.5 / np.maximum(gap, SMOOTH / 2)
    raise ValueError(f"unknown loss: {p.loss}")


class _Rows:
    """Passes over the rows for a set of problems."""

    def __init__(self, rows: DataFrame, width: int, n_classes: int, weights: dict[int, np.ndarray]):
        self.width, self.n_classes, self.weights = width, n_classes, weights
        self.context, self.rows = rows.sparkSession.sparkContext, packed(rows, ["y", "fold"])

    def _pass(self, work: Callable, problems: Sequence[Problem], sent: tuple, shape: tuple[int, int]) -> np.ndarray:
        weights, width = self.weights, self.width
        shared = self.context.broadcast(sent)
        columns = _columns(problems, self.n_classes)

        def run(out, x, y, fold) -> None:
            row_weight = [np.where(fold == p.fold, 0.0, p.C * weights[p.fold][y]) for p in problems]
            work(out, x, y, row_weight, columns, shared.value)

        try:
            return sum_of_packed(self.rows, width, run, shape)
        finally:
            shared.unpersist()

    def slopes(self, problems: Sequence[Problem], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objective per problem, gradient and diagonal of the second derivatives, from one pass."""
        n, size = w.shape[1], self.width + 1

        def work(out, x, y, row_weight, columns, sent):
            score = x.times(sent[0][:-1]) + sent[0][-1]  # the last row holds the intercepts
            slope, curve = np.zeros_like(score), np.zeros_like(score)
            for p, c, s in zip(problems, columns, row_weight, strict=True):
                loss, a, b = _derivatives(p, score[:, c], y)
                slope[:, c], curve[:, c] = a * s[:, None], b * s[:, None]
                out[c.start, -1] += loss @ s
            out[:, : size - 1] += x.summed(slope)
            out[:, size - 1] += slope.sum(axis=0)
            out[:, size : 2 * size - 1] += x.summed(curve, square=True)
            out[:, 2 * size - 1] += curve.sum(axis=0)

        found = self._pass(work, problems, (w,), (n, 2 * size + 1))
        slope, curve = found[:, :size].T + w, found[:, size : 2 * size].T + 1
        slope[-1] -= w[-1]
        curve[-1] -= 1
        value = [found[c, -1].sum() + 0.5 * (w[:-1, c] ** 2).sum() for c in _columns(problems, self.n_classes)]
        return np.asarray(value), slope, np.maximum(curve, 1e-9)

    def products(self, problems: Sequence[Problem], w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Second derivatives at w times v, from one pass."""

        def work(out, x, y, row_weight, columns, sent):
            score, way = (x.times(w[:-1]) + w[-1] for w in sent)
            bent = np.zeros_like(score)
            for p, c, s in zip(problems, columns, row_weight, strict=True):
                _, slope, curve = _derivatives(p, score[:, c], y)
                if p.loss == "softmax":
                    share = slope.copy()
                    share[np.arange(len(y)), y] += 1
                    turned = share * (way[:, c] - (share * way[:, c]).sum(axis=1, keepdims=True))
                else:
                    turned = curve * way[:, c]
                bent[:, c] = turned * s[:, None]
            out[:, :-1] += x.summed(bent)
            out[:, -1] += bent.sum(axis=0)

        found = self._pass(work, problems, (w, v), (w.shape[1], self.width + 1)).T + v
        found[-1] -= v[-1]
        return found


def fit(
    rows: DataFrame, width: int, n_classes: int, problems: Sequence[Problem], weights: dict[int, np.ndarray] | None = None,
    tolerance: float = 1e-4, least_gain: float = 0.0,
) -> list[np.ndarray]:
    """Weights of all problems, (width + 1) × columns each, the intercept last.

    `rows` come from `labelled_rows`; cache or write them before. A problem is done when its gradient
    has fallen below `tolerance` times the first one, or a step lowers its objective by no more than the
    share `least_gain`. Each Newton step solves its equations roughly by conjugate gradients (scaled by
    the diagonal) and halves the step until the objective falls.
    """
    for p in problems:
        if p.loss not in LOSSES:
            raise ValueError(f"unknown loss: {p.loss}; choose from {', '.join(LOSSES)}")
    if not problems:
        return []
    weights = balanced_weights(rows, n_classes, sorted({p.fold for p in problems})) if weights is None else weights
    data = _Rows(rows, width, n_classes, weights)
    try:
        return _solve(data, problems, tolerance, least_gain)
    finally:
        data.rows.unpersist()


def _solve(data: _Rows, problems: Sequence[Problem], tolerance: float, least_gain: float) -> list[np.ndarray]:
    n_classes, columns = data.n_classes, _columns(problems, data.n_classes)
    w = np.zeros((data.width + 1, columns[-1].stop))
    value, slope, curve = data.slopes(problems, w)
    norm = lambda m, i: float(np.linalg.norm(m[:, columns[i]]))
    first = [norm(slope, i) for i in range(len(problems))]
    for _ in range(NEWTON_STEPS):
        going = [i for i in range(len(problems)) if norm(slope, i) > tolerance * max(first[i], 1e-12)]
        if not going:
            break
        step = _newton_direction(data, problems, columns, going, w, slope, curve, first)
        length = np.zeros(len(problems))
        length[going] = 1.0
        waiting = set(going)
        for _ in range(HALVINGS):
            some = sorted(waiting)
            tried = _take([w + step * _spread(length, columns)], columns, some)[0]
            new_value, new_slope, new_curve = data.slopes([problems[i] for i in some], tried)
            inner = _columns([problems[i] for i in some], n_classes)
            for j, i in enumerate(some):
                c = columns[i]
                fall = (slope[:, c] * step[:, c]).sum()
                if new_value[j] <= value[i] + 1e-4 * length[i] * fall + 1e-12 * abs(value[i]):
                    w[:, c], slope[:, c], curve[:, c] = tried[:, inner[j]], new_slope[:, inner[j]], new_curve[:, inner[j]]
                    if value[i] - new_value[j] <= least_gain * abs(value[i]):
                        first[i] = np.inf  # nothing to be gained any more
                    value[i] = new_value[j]
                    waiting.discard(i)
                else:
                    length[i] /= 2
            if not waiting:
                break
        for i in waiting:  # no step is downhill any more: at the limit of the arithmetic
            first[i] = np.inf
    return [w[:, c].copy() for c in columns]


def _spread(per_problem: np.ndarray, columns: list[slice]) -> np.ndarray:
    return np.concatenate([np.full(c.stop - c.start, v) for v, c in zip(per_problem, columns, strict=True)])


def _take(tables: Sequence[np.ndarray], columns: list[slice], some: Sequence[int]) -> list[np.ndarray]:
    """The columns of some of the problems."""
    at = np.concatenate([np.arange(columns[i].start, columns[i].stop) for i in some])
    return [t[:, at] for t in tables]


def _newton_direction(data, problems, columns, going, w, slope, curve, first) -> np.ndarray:
    """Approximate solutions d of  H d = −slope  for the problems that go on, one pass a step for all."""
    d = np.zeros_like(w)
    rest = -slope
    scaled = rest / curve
    way = scaled.copy()
    energy = [(rest[:, c] * scaled[:, c]).sum() for c in columns]
    start = [np.linalg.norm(slope[:, c]) for c in columns]
    open_ = list(going)
    for _ in range(CG_STEPS):
        image = data.products([problems[i] for i in open_], *_take([w, way], columns, open_))
        inner = _columns([problems[i] for i in open_], data.n_classes)
        left = []
        for j, i in enumerate(open_):
            c, hv = columns[i], image[:, inner[j]]
            bend = (way[:, c] * hv).sum()
            if bend <= 0:
                if not d[:, c].any():
                    d[:, c] = scaled[:, c]
                continue
            pace = energy[i] / bend
            d[:, c] += pace * way[:, c]
            rest[:, c] -= pace * hv
            if np.linalg.norm(rest[:, c]) <= min(0.25, np.sqrt(start[i] / first[i])) * start[i]:
                continue
            scaled[:, c] = rest[:, c] / curve[:, c]
            new = (rest[:, c] * scaled[:, c]).sum()
            way[:, c] = scaled[:, c] + new / energy[i] * way[:, c]
            energy[i] = new
            left.append(i)
        open_ = left
        if not open_:
            break
    return d


def score_counts(rows: DataFrame, width: int, n_classes: int, models: Sequence[tuple[np.ndarray, int]]) -> np.ndarray:
    """Confusion counts (model, truth, choice) of many linear models, from one pass.

    A model is (weights, fold): (width + 1) × classes and the fold it is judged on, −1 for all rows.
    Ties go to the first class.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.concatenate([m for m, _ in models], axis=1))
    judged = [fold for _, fold in models]

    def run(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros((len(judged), n_classes * n_classes))
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                score = densify(part["indices"], part["values"], width) @ shared.value[:-1] + shared.value[-1]
                choice = score.reshape(len(part), len(judged), n_classes).argmax(axis=2)
                y, fold = part["y"].to_numpy(), part["fold"].to_numpy()
                for m, own in enumerate(judged):
                    rows_ = slice(None) if own < 0 else fold == own
                    out[m] += np.bincount(y[rows_] * n_classes + choice[rows_, m], minlength=n_classes * n_classes)
        return out

    try:
        return sum_of_matrices(rows, run).reshape(-1, n_classes, n_classes)
    finally:
        shared.unpersist()


def weighted_f1(counts: np.ndarray) -> float:
    """F1 of the classes weighted by their rows, from confusion counts (truth, choice)."""
    hit, truth, chosen = np.diag(counts), counts.sum(axis=1), counts.sum(axis=0)
    f1 = np.divide(2 * hit, truth + chosen, out=np.zeros(len(hit)), where=truth + chosen > 0)
    return float((f1 * truth).sum() / truth.sum()) if truth.sum() else 0.0


def class_scores(weights: Sequence[np.ndarray], n_classes: int) -> np.ndarray:
    """Weights of one model as a column per class.

    A softmax problem has them; one-against-rest problems are put side by side, and a single problem
    with two classes speaks for the second one.
    """
    whole = np.concatenate(list(weights), axis=1)
    if whole.shape[1] == n_classes:
        return whole
    return np.concatenate([np.zeros_like(whole), whole], axis=1)


@dataclass(frozen=True)
class LinearModel:
    """A fitted linear classifier; `transform` adds `predicted_<label>` to rows with a vector."""

    weights: np.ndarray  # (width + 1) × classes, the intercept last
    classes: tuple[str, ...]
    label: str
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        weights, classes = self.weights, np.asarray(self.classes, dtype=object)

        def choose(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for indices, values in batches:
                best = [
                    (densify(indices.iloc[at : at + CHUNK], values.iloc[at : at + CHUNK], len(weights) - 1) @ weights[:-1] + weights[-1]).argmax(axis=1)
                    for at in range(0, len(indices), CHUNK)
                ]
                yield pd.Series(classes[np.concatenate(best)] if best else [], dtype=object)

        raw = F.unwrap_udt(self.features)
        every = F.transform(raw["values"], lambda _, i: i)
        chosen = F.pandas_udf(choose, "string")
        return df.withColumn(f"predicted_{self.label}", chosen(F.coalesce(raw["indices"], every), raw["values"]))

    def table(self, df: DataFrame) -> DataFrame:
        """(class, index, weight) of all intercepts (index −1) and other weights that are not 0, to be stored and read back."""
        last = len(self.weights) - 1
        at, k = np.nonzero((self.weights != 0) | (np.arange(last + 1) == last)[:, None])
        frame = pd.DataFrame({
            "class": [self.classes[j] for j in k], "index": np.where(at == last, -1, at), "weight": self.weights[at, k],
        })
        return df.sparkSession.createDataFrame(frame, "class string, index int, weight double")

    @staticmethod
    def from_table(table: DataFrame, width: int, label: str, features: str = "features") -> LinearModel:
        rows = table.collect()  # at most width + 1 per class
        classes = tuple(sorted({r["class"] for r in rows}))
        weights = np.zeros((width + 1, len(classes)))
        for r in rows:
            weights[r["index"] if r["index"] >= 0 else width, classes.index(r["class"])] = r["weight"]
        return LinearModel(weights, classes, label, features)


def train(
    df: DataFrame, label: str, loss: str = "squared_hinge", C: float = 1.0, features: str = "features", tolerance: float = 1e-2,
) -> LinearModel:
    """Fit one classifier on rows with a vector and a label, classes weighted alike.

    Losses other than softmax are fitted one class against the others, in shared passes.
    """
    known = df.where(F.col(label).isNotNull())
    classes = tuple(r[0] for r in known.select(F.col(label).cast("string")).distinct().orderBy(label).collect())
    rows = written(labelled_rows(known, label, classes, features), "rows")
    vector = F.unwrap_udt(features)
    size = known.select(F.coalesce(vector["size"], F.size(vector["values"])).alias("n")).agg(F.max("n")).first()[0] or 0
    two = len(classes) == 2 and loss != "softmax"
    targets = [None] if loss == "softmax" else [1] if two else range(len(classes))
    found = fit(rows, size, len(classes), [Problem(loss, C, t) for t in targets], tolerance=tolerance)
    return LinearModel(class_scores(found, len(classes)), classes, label, features)
