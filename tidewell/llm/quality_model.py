"""Operator 2: a quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; unlabelled web text is everything else that may be
learned from. The classifier minimises the non-negative unbiased risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])
with the logistic loss over features of form (symbols, case, repetition, lines, word shapes). With
this loss the risk is the higher of two smooth convex functions: the positives' part alone, and the
unbiased risk. Each step takes the direction that lowers the higher of their linear models most under
the curvature of their mix, so at the bound, where both are equal, steps go along it; the share of the
unbiased risk in the mix has a closed form. A step is halved until the risk falls enough.

The class prior is estimated from positives and unlabelled text: the unlabelled share above any
threshold of a score, divided by the positives' share above it, bounds the prior from above, and the
least such bound, with an allowance for chance, is taken (best bin estimation). The score is that of a
first model with a prior of one half.

Features of every text are computed once and written; positives and unlabelled rows, all of them, enter
the risk through sums that Spark adds up for each Newton step, so nothing but a vector and a matrix of
N_FEATURES reaches the driver. Every text is scored whole. Null and empty texts have features of their
own (no words) and get a score like any other; very long texts are read whole, in one pass. Rows that repeat count and are scored each on their own;
a doc_id with several labels is good if one of them is. Without positives, or without unlabelled rows,
every text scores the prior. An empty table gives no rows. Other columns of docs are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts
from .learn import sigmoid

N_FEATURES = 18
#: Ridge on the weights, steps at most, and the promised fall of the risk below which they end.
RIDGE, ROUNDS, ENOUGH = 1e-4, 60, 1e-5
#: Bins of the score, and the chance that the prior's bound does not hold.
BINS, DELTA = 1_000, 0.1
_LETTERS = np.array([chr(b).isalpha() if b < 128 else b >= 0xC0 for b in range(256)], float)
_UPPER = np.array([65 <= b <= 90 for b in range(256)], float)
_DIGIT = np.array([48 <= b <= 57 for b in range(256)], float)
_GROUPS = np.stack([np.array([chr(b) in g for b in range(256)], float) for g in ("#*$%&", "|<>", "!?", ".,;:")])


def features(text: str) -> list[float]:
    """Numbers on the form of a text; all are bounded or logarithms."""
    raw = text.encode()
    words = raw.split()
    n, lines = len(words), [x for x in raw.split(b"\n") if x.strip()]
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    letters, size = max(hist @ _LETTERS, 1.0), float(len(raw))
    symbols, bars, marks, stops = (_GROUPS @ hist) / n
    kinds = len(set(words))
    same = sum(map(eq, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    ends = sum(w[-1] in b".,;:" for w in words) / n
    return [
        math.log(n), math.log(size / n), hist @ _UPPER / letters, math.sqrt(hist @ _UPPER / letters),
        hist @ _DIGIT / size, min(symbols, 4), math.sqrt(symbols), min(bars, 2), math.sqrt(bars), min(marks, 4), math.sqrt(marks),
        min(stops, 2), ends, kinds / n, math.log(kinds) / max(math.log(n), 0.5), math.sqrt(same), 1 - pairs,
        len(set(lines)) / len(lines) - 1 if lines else 0.0,
    ]


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features of its text as bytes, of every row; written once."""

    def run(batches):
        for batch in slices(batches):
            rows = np.array([features(t) for t in texts(batch)], "<f8").reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "x"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary"), "quality-features")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, N_FEATURES)


@dataclass
class QualityModel:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Features with mean 0 and deviation 1, and the constant 1 last."""
        return np.hstack([np.clip((x - self.mean) / self.std, -8, 8), np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scaled(x) @ self.weights)


def _sums(rows: DataFrame, part) -> np.ndarray:
    """part(x, y) added over all rows(y, x): tasks add their batches, Spark the tasks."""

    def run(batches):
        total = None
        for batch in slices(batches):
            got = part(_matrix(batch.column(1)), batch.column(0).to_numpy())
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    got = rows.select("y", "x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(part(np.zeros((0, N_FEATURES)), np.zeros(0))))
    for r in got:
        out[r.k] = r.v
    return out


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[(y == 1).sum(), (y == 0).sum()], x.sum(0), (x * x).sum(0)])


def risk_parts(model: QualityModel):
    """Sums from which the risk of a model, its gradient and its second derivatives follow."""

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pos, unl = model.scaled(x[y == 1]), model.scaled(x[y == 0])
        z, u = pos @ model.weights, unl @ model.weights
        q, p = sigmoid(z), sigmoid(u)
        bends = [(rows * (c * (1 - c))[:, None]).T @ rows for rows, c in ((pos, q), (unl, p))]
        return np.concatenate([[_soft(z).sum(), _soft(-z).sum(), _soft(u).sum()], pos.sum(0), q @ pos, p @ unl, *(b.ravel() for b in bends)])

    return part


@dataclass
class _Risk:
    """Both functions whose higher one is the risk (positives' part, unbiased risk): values, gradients, second derivatives."""

    values: np.ndarray
    grads: np.ndarray
    bends: np.ndarray

    def step(self, share: float) -> tuple[np.ndarray, float, float]:
        """The step under the curvature that `share` of the unbiased risk gives, the new share, and the fall that the step promises."""
        bend = (1 - share) * self.bends[0] + share * self.bends[1] + 1e-6 * np.eye(len(self.bends[0]))
        apart = self.grads[1] - self.grads[0]
        to_first, to_apart = np.linalg.solve(bend, np.stack([self.grads[0], apart], 1)).T
        gap = self.values[1] - self.values[0]
        share = float(np.clip((gap - self.grads[0] @ to_apart) / max(apart @ to_apart, 1e-30), 0, 1))
        step = -(to_first + share * to_apart)
        model = max(self.values + self.grads @ step) + step @ bend @ step / 2
        return step, share, max(self.values) - model


def fit_nonnegative(rows: DataFrame, model: QualityModel, n: tuple[float, float]) -> QualityModel:
    """The model with weights that minimise the non-negative risk over rows(y, x); n: how many have y of 1 and of 0."""
    k, prior = N_FEATURES + 1, model.prior
    ridge = np.append(np.full(N_FEATURES, RIDGE), 1e-9)

    def at(w) -> _Risk:
        got = _sums(rows, risk_parts(QualityModel(model.mean, model.std, w, prior)))
        sums, (pos, pos_q, unl_p), bends = got[:3], got[3 : 3 + 3 * k].reshape(3, k), got[3 + 3 * k :].reshape(2, k, k)
        held = (ridge * w * w).sum() / 2
        first = prior * sums[1] / n[0] + held
        unbiased = first + sums[2] / n[1] - prior * sums[0] / n[0]
        grads = np.stack([prior * (pos_q - pos) / n[0], unl_p / n[1] - prior * pos / n[0]]) + ridge * w
        return _Risk(np.array([first, unbiased]), grads, np.stack([prior * bends[0] / n[0], bends[1] / n[1]]) + np.diag(ridge))

    w, share = model.weights, 1.0
    risk = at(w)
    for _ in range(ROUNDS):
        step, share, promised = risk.step(share)
        if promised < ENOUGH:
            break
        size = 1.0
        while (new := at(w + size * step)).values.max() > risk.values.max() - 0.1 * size * promised:
            size /= 2
            if size < 1e-6:
                return QualityModel(model.mean, model.std, w, prior)
        w, risk = w + size * step, new
    return QualityModel(model.mean, model.std, w, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = DELTA) -> float:
    """Share of positives in unlabelled text, from counts of both by bins of rising score."""
    n, m = max(positive.sum(), 1), max(unlabelled.sum(), 1)
    above = lambda counts, total: np.cumsum(counts[::-1])[::-1] / total
    p, u = above(positive, n), above(unlabelled, m)
    slack = math.sqrt(math.log(4 / delta) / (2 * m)) + math.sqrt(math.log(4 / delta) / (2 * n))
    some = p > 0
    best = np.argmin((u[some] + slack) / p[some])
    return float(np.clip((u[some] / p[some])[best], 0.02, 0.98))


def _histogram(model: QualityModel):
    def part(x, y):
        bins = np.minimum((model.scores(x) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(bins[y == v], minlength=BINS) for v in (1, 0)]).astype(float)

    return part


def fit(featured: DataFrame, labels: DataFrame, learn: Column, prior: float | None = None) -> QualityModel:
    """Learn from labels(doc_id, quality) and the unlabelled rows of featurize() for which `learn` holds."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = featured.where(learn).join(known, "doc_id", "left").where("quality is null or quality = 1")
    rows = materialize(joined.select(F.coalesce("quality", F.lit(0)).cast("int").alias("y"), "x"), "quality-rows")
    moments = _sums(rows, _moments)
    n, sums = (moments[0], moments[1]), moments[2:].reshape(2, -1) / max(moments[0] + moments[1], 1)
    start = QualityModel(sums[0], np.sqrt(np.maximum(sums[1] - sums[0] ** 2, 1e-12)), np.zeros(N_FEATURES + 1), prior or 0.5)
    if not n[0] or not n[1]:
        start.weights[-1] = math.log(start.prior / (1 - start.prior))
        return start
    model = fit_nonnegative(rows, start, n)
    if prior is None:
        counts = _sums(rows, _histogram(model))
        model.prior = estimate_prior(counts[:BINS], counts[BINS:])
        model = fit_nonnegative(rows, model, n)
    return model


def score(featured: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score: the probability that a document is good, from featurize()."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return featured.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
